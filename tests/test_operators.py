"""Properties and edge cases of the operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import replies as R
from docloom.functions import text as T
from docloom.functions.vectors import similarity
from docloom.operators import chunking as C
from docloom.operators import extraction as X
from docloom.operators import graph as G
from docloom.operators import store as S
from docloom.operators.domains import DOMAINS, classify, domain, percentile_of
from docloom.operators.markdown import to_plain
from docloom.operators.providers import Provider, RuleExtractor
from docloom.plans.knowledge import build, save
from docloom.sources.documents import load_status, read_files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("s", ["  a b ", " x ", "\x85\n a 　", "", "\t", "żółć  "])
def test_trim_is_pythons(spark, s):
    assert one(spark, s, T.trim_u) == s.strip()


@pytest.mark.parametrize("s", ["a  b\n c\t d \n\n", "", " x ", "l1\n\n\nl2"])
def test_cleanup_text(spark, s):
    want = "\n".join(" ".join(x.split()) for x in s.split("\n")).strip()
    assert one(spark, s, T.cleanup_text) == want
    assert one(spark, want, T.cleanup_text) == want


def test_line_chunks_round_trip(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join("x" * rng.randrange(5) for _ in range(rng.randrange(1, 45)))) for i in range(20)]
    rows = C.by_lines(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "chunk_id").collect()
    for i, text in docs:
        own = [r for r in rows if r.doc_id == i]
        assert "\n".join(r.text for r in own) == text
        assert all(text[r.start : r.end] == r.text for r in own)


def test_windows_cover_the_text(spark):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("ab .\n") for _ in range(rng.randrange(0, 900)))) for i in range(30)]
    rows = C.model_aware(spark.createDataFrame(docs, "doc_id long, text string"), 200, 50).collect()
    for i, text in docs:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_id)
        assert bool(own) == bool(text)
        for r in own:
            assert text[r.start : r.end] == r.text and r.start == r.chunk_id * 150
        if own:
            assert own[-1].end == len(text) or len(own) == 100
            assert not own[0].overlap_start and not own[-1].overlap_end


def test_chunk_dispatch(spark):
    docs = spark.createDataFrame([(1, "One two. " * 60), (2, None), (3, "")], "doc_id long, text string")
    assert percentile_of(["literary"]) == 92 and percentile_of([]) == 90
    assert C.chunk(docs, ["simple"]).where("doc_id = 1").count() >= 1
    assert C.chunk(docs, ["owu"]).where("doc_id = 1").count() >= 1
    assert C.chunk(docs, strategy="line").where("doc_id = 3").first().text == ""
    with pytest.raises(ValueError):
        domain("none")
    assert len(DOMAINS["owu"].types) == 46 - 2 or len(DOMAINS["owu"].types) > 40


def test_validation_keeps_other_rows(spark):
    raw = [("a", " Anna ", "character", "0.9", ["anna", "Ania", "Ania", " "]), ("b", "", "CHARACTER", "0.9", None), ("c", "Bob", "CHARACTER", "nan", None), ("d", "Eve", "OTHER", "1", None), ("e", "x" * 101, "DATE", "1", None), ("f", "Zoe", "CHARACTER", "-3", None)]
    df = spark.createDataFrame([(k, n, t, None, c, a, None) for k, n, t, c, a in raw], "k string, name string, type string, description string, confidence string, aliases array<string>, evidence string")
    got = {r.k: r for r in X.validate(df, ["CHARACTER", "DATE"]).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"].aliases == ["Ania"] and got["a"].type == "CHARACTER" and got["c"].confidence == 0.5
    again = X.validate(X.validate(df, ["CHARACTER", "DATE"]).withColumn("confidence", F.col("confidence").cast("string")), ["CHARACTER", "DATE"])
    assert again.count() == 2


@pytest.mark.parametrize("reply,n", [('```json\n{"entities": [{"name": "A"}]}\n```', 1), ('[{"name": "A"}, {"name": "B"}]', 2), ("no json", 0), ("", 0), ('{"entities": 3}', 0)])
def test_entity_replies(spark, reply, n):
    assert len(one(spark, reply, R.entity_reply).entities) == n


@pytest.mark.parametrize("reply,want", [('{"domains": ["owu", "x"]}', ["owu"]), ('["LITERARY"]', ["literary"]), ("bad", ["simple"]), (None, ["simple"])])
def test_classification(spark, reply, want):
    assert one(spark, reply, classify) == want


def test_similarity_is_bounded_and_symmetric(spark):
    df = spark.createDataFrame([([1.0, 0.0], [-1.0, 0.0]), ([0.6, 0.8], [0.8, 0.6]), (None, [1.0])], "a array<double>, b array<double>")
    rows = df.select(similarity(F.col("a"), F.col("b")).alias("x"), similarity(F.col("b"), F.col("a")).alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows] and rows[0].x == 0 and 0.9 < rows[1].x <= 1 and rows[2].x == 0


def test_hops_grow_with_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "k"), ("k", "d")], "source_id string, target_id string")
    ents = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    start = ents.where("id = 'a'")
    found = [{r.id for r in G.within_hops(e, start, ents, h).collect()} for h in (1, 2, 3)]
    assert found == [{"b"}, {"b", "c"}, {"b", "c", "d"}]


def test_upsert_edges_and_delete(spark):
    e = spark.createDataFrame([("a", "b", "R", 0.5, 1), ("a", "b", "R", 0.7, 2), ("b", "c", "R", 0.1, 1)], "source_id string, target_id string, relation_type string, confidence double, created_at int")
    kept = G.upsert_edges(e.limit(0), e)
    assert {(r.source_id, r.confidence) for r in kept.collect()} == {("a", 0.7), ("b", 0.1)}
    ents = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    left, edges = S.delete(ents, kept, ents.where("id = 'c'"))
    assert left.count() == 2 and edges.count() == 1


def test_markdown(spark):
    md = "# T\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 |\nnext **x**\n\n*i* [l](u) `c`"
    got = to_plain(spark.createDataFrame([(1, md), (2, None)], "doc_id long, text string"))
    rows = {r.doc_id: r.text for r in got.collect()}
    assert rows[1] == "T\na: 1; b: 2\na: 3\nnext **x**\ni l c" and rows[2] == ""


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("Anna met Robert in Paris. ".encode() * 20)
    (tmp_path / "in/b.md").write_bytes("caf\xe9 Maria".encode("latin-1"))
    (tmp_path / "in/c.txt").write_text("  \n ")
    (tmp_path / "in/d.exe").write_text("x")
    (tmp_path / "in/e.rtf").write_text(r"{\rtf1{\fonttbl{\f0 Arial;}}Hello \b World\b0\par next}")
    docs, errors = read_files(spark, str(tmp_path / "in"))
    text = {r.source_file.rsplit("/", 1)[1]: r.content for r in docs.collect()}
    assert text["b.md"] == "café Maria" and text["e.rtf"].startswith("Hello World") and set(text) == {"a.txt", "b.md", "e.rtf"}
    assert {r.source_file.rsplit("/", 1)[1] for r in errors.collect()} == {"c.txt", "d.exe"}
    assert {r["status"]: r["count"] for r in load_status(docs, errors).collect()} == {"success": 3, "failed": 2}
    graph = build(spark, docs.selectExpr("source_file AS doc_id", "content AS text"), f"{tmp_path}/work", ["literary"])
    n = graph.entities.count()
    assert n > 0 and graph.edges.count() == n and graph.export().count() > n
    assert build(spark, docs.limit(0).selectExpr("source_file AS doc_id", "content AS text"), f"{tmp_path}/work").entities.count() == n  # complete stages are kept
    store = save(spark, graph, f"{tmp_path}/store", keep=2)
    for _ in range(3):
        store.save("edges", graph.edges)
    assert store.versions("edges") == [3, 4] and store.load("entities").count() == n and store.restore("edges", 3) == 5
    assert store.sizes()["entities"][1] > 0


def test_provider_failures_are_rows(spark):
    def call(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("429")
        return ['[{"name": "Anna", "type": "CHARACTER"}]'] * len(prompts)

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id long, text string").coalesce(1)
    rows = {r.id: r for r in X.ask(df, Provider("p", call, batch=1), "simple").collect()}
    assert rows[1].reply and rows[2].error.endswith("429") and rows[2].reply is None


def test_rule_extractor_finds_kinds(spark):
    df = spark.createDataFrame([(1, "Anna wrote to a.b@c.de in 1999")], "doc_id long, text string")
    assert {(r.name, r.type) for r in X.mentions(df, RuleExtractor()).collect()} == {("Anna", "CHARACTER"), ("a.b@c.de", "ADDRESS"), ("1999", "DATE")}


def test_entity_card_and_context(spark):
    ents = spark.createDataFrame([("a", "Anna", "P", ["x"] * 12, None, 0.9, "c"), ("b", "Bob", "P", [], "d", 0.8, None), ("c", "Cid", "P", [], None, 0.7, None)], "id string, name string, type string, aliases array<string>, description string, confidence double, context string")
    e = spark.createDataFrame([("a", "b", "KNOWS"), ("b", "c", "KNOWS"), ("a", "a", "SELF")], "source_id string, target_id string, relation_type string")
    own, edges, related = S.card(ents, e, "a")
    assert own.count() == 1 and edges.count() == 3 and [r.id for r in related.collect()] == ["b", "c"]
    hits = spark.createDataFrame([("a", 0.7), ("c", 0.9), ("zz", 1.0)], "id string, score double")
    got = S.contextual_entities(hits, ents).collect()
    assert [r.id for r in got] == ["c", "a"] and len(got[1].aliases) == 10
    assert {r.id: r.context_text for r in S.embedding_texts(ents).collect()} == {"a": "Anna P c", "b": "Bob P d", "c": "Cid P"}


def test_config_check():
    from docloom.operators.providers import checked, context_limit, output_limit

    assert checked({"model": "m", "vision_prompt": "p"})["model"] == "m"
    with pytest.raises(ValueError):
        checked({"model": " ", "vision_prompt": "p"})
    assert context_limit("unknown") == 32_768 and output_limit("unknown") == 8_192 and C.chunk_size("unknown") == int((32_768 - 1500) * 0.75)


def test_context_join_in_blocks(spark):
    from docloom.operators.search import top_k_join

    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "id long, embedding array<double>")
    q = v.where("id < 9").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    rows = [top_k_join(q, v, 3, 2.0, query_rows=n).orderBy("query_id", "rank").collect() for n in (2, 64)]
    assert rows[0] == rows[1] and rows[0]
    assert top_k_join(q.limit(0), v, 3, 2.0).count() == 0
