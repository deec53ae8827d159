"""Queries do the whole job: nothing is left out by a cap, a prefix or a filter on ids."""

from __future__ import annotations

def test_word_windows_hold_every_word(spark, tmp_path):
    from docloom import registry

    words = [f"w{i}" for i in range(4321)]
    spark.createDataFrame([(1, " ".join(words)), (2, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["chunk_word_window"](spark, str(tmp_path)).where("doc_id = 1").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == list(range(29)) and all(r.text.split() == words[r.chunk_id * 150 : r.chunk_id * 150 + 200] for r in rows)


def test_model_aware_windows_reach_the_end(spark, tmp_path):
    from docloom import registry

    text = "".join(f"word{i} " for i in range(14_000))
    spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: registry.queries()[name](spark, str(tmp_path))
    for name in ("chunk_model_aware", "chunk_model_aware_smart"):
        rows = run(name).where("doc_id = 1").orderBy("chunk_id").collect()
        assert len(text) > 100_000 and len(rows) == -(-(len(text) - 200) // 800) and rows[-1].end == len(text)
        assert all(r.start == 800 * r.chunk_id and text[r.start : r.end] == r.text for r in rows)
    s = run("chunk_stats").first()
    assert s.chunks == len(rows) + 1 and s.total == len(text) + 200 * (len(rows) - 1) + 3
    assert run("chunk_overlap").count() == len(rows) - 1


def test_every_title_is_compared(spark, tmp_path):
    from docloom import registry

    v = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, 1.0]]
    spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.doc_id: r.matches for r in registry.queries()["title_match"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True, 5: False, 6: None}


def test_markdown_of_whole_turns(spark, tmp_path):
    from docloom import registry

    turn = "A first line | with a pipe.\n\n- a **bold** item\n\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\nthe end"
    spark.createDataFrame([(1, 2, "user", turn)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.queries()["md_to_plain"](spark, str(tmp_path)).first()
    cell = "key: user; value: A first line with a pipe. - a **bold** item a b"
    lines = got.text.split("\n")
    assert got.doc_id == 1002 and lines[0] == "Head user" and lines[1].startswith(cell) and lines[1].endswith("after the end")
    assert lines[2:] == ["after *it*", "see link and code user", "A first line | with a pipe.", "- a bold item", "a: 1; b: 2", "after", "the end"]
