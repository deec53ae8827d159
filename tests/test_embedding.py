"""Letter vectors are made in one pass over each text."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from docloom import registry
from docloom.operators.providers import LetterEmbedder


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_of_odd_texts_in_one_pass(spark, tmp_path):
    long = "Zażółć " * 300_000  # more than is counted at once
    texts = ["Hello, World", "", None, "1234 ß", "İİ K k", long, "abc" * 5, "[@`{|}~ZAza"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["embed_letters"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {k: list(v) for k, v in c.execute(registry.oracle_sql()["embed_letters"]).fetchall()}
    assert {r.doc_id: list(r.embedding) for r in got.collect()} == want
    plan = _plan(got)
    assert plan.count("replace(") == 0 and "ArrowEvalPython" in plan


def test_letters_of_arrays(spark):
    rows = spark.createDataFrame([(0, ["ab", "", "KB"]), (1, []), (2, None), (3, ["z"])], "id long, texts array<string>")
    e = LetterEmbedder()
    one = {r.text: r.v for r in rows.select(F.explode("texts").alias("text")).select("text", e.embed(F.col("text")).alias("v")).collect()}
    got = {r.id: r.v for r in rows.select("id", e.embed_all(F.col("texts")).alias("v")).collect()}
    assert got == {0: [one["ab"], one[""], one["KB"]], 1: [], 2: [], 3: [one["z"]]} and one["z"][25] == 1.0 and one["KB"][10] > 0


def test_write_back_makes_keys_once_and_shuffles_no_text_for_the_lookup(spark, tmp_path):
    """What is looked up goes to the join as a key alone; texts are moved to find distinct misses only."""
    rows = [(i, f"  text {i % 7}\n", "en" if i % 2 else "de") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["embed_write_back"](spark, str(tmp_path))
    assert sorted((r.doc_id, r.embedded, r.cached) for r in got.collect()) == [(i, True, 7) for i in range(20)]
    plan = _plan(got)
    assert "regexp_replace" not in plan
    lookup = plan[: plan.index("Union")]
    assert lookup.count("sha2(") == 1


def test_trimming_is_that_of_python(spark):
    from docloom.functions.text import trim_u

    every = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    texts = ["", " ", every, every + "a" + every + "b" + every, "a", "​x​", "x\r\n", "\U0001f600 "]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(trim_u(F.col("t"))).collect()] == [t.strip() for t in texts]
