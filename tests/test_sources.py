"""Page scans without a parser, sinks, streams and the command line."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from docloom.cli import main
from docloom.sources import pages as P
from docloom.sources import sinks as K
from docloom.streaming.refresh import append_once, each_batch, lines_as_documents, watch, windowed_counts


def test_scan_reports_bad_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"12")), ("b", bytearray(b"x"))], "path string, content binary")
    got = {r.source_file: r for r in P.scan(files, lambda d: iter([{"page": int(d), "text": "t"}]), P.PAGES).collect()}
    assert got["a"].page == 12 and got["a"].error is None and got["b"].error.startswith("ValueError")
    assert P.zoom(2400) == 0.5 and P.zoom(600) == 2 and P.zoom(1) == 3 and P.zoom(0) == 1


def test_graphml_and_files(spark, tmp_path):
    n = spark.createDataFrame([("a", 'x"<', ["p"]), ("b", None, None)], "id string, name string, tags array<string>")
    e = spark.createDataFrame([("a", "b", 0.5)], "source_id string, target_id string, confidence double")
    text = "".join(r.line for r in K.graphml(n, e).orderBy("ord").collect())
    from xml.etree import ElementTree

    root = ElementTree.fromstring(text)
    assert len(root[0]) == 3 and root[0][0][0].text == 'x"<' and root[0][0][1].text == '["p"]' and len(root[0][1]) == 0
    c = spark.createDataFrame([("d/1", 0, "one"), ("d/1", 1, "two")], "doc_id string, chunk_id int, text string")
    K.write_chunk_files(c, f"{tmp_path}/c")
    back = spark.read.text(f"{tmp_path}/c")
    assert {(r.document, r.chunk, r.value) for r in back.collect()} == {("d_1", "chunk_000", "one"), ("d_1", "chunk_001", "two")}
    K.write_pages(c, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    K.call_log(spark.createDataFrame([("p", "r", None)], "prompt string, reply string, error string"), f"{tmp_path}/l")
    assert spark.read.parquet(f"{tmp_path}/l").first().reply_length == 1


def test_stream_counts_once_after_restart(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    spark.range(5).write.parquet(src)
    for extra in (0, 3, 0):
        if extra:
            spark.range(100, 100 + extra).write.mode("append").parquet(src)
        q = each_batch(watch(spark, src, "id long", "*.parquet"), append_once(out, ["id"]), state, every=None)
        q.awaitTermination()
    assert spark.read.parquet(out).count() == 8


def test_lines_and_windows(spark, tmp_path, sf):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("one  line\n\n two\n")
    q = lines_as_documents(spark, f"{tmp_path}/t").writeStream.format("memory").queryName("docs_in").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.text for r in spark.table("docs_in").collect()} == {"one line", "two"}
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Maria met Robert. " * 30)
    assert main([f"{tmp_path}/in", "--store", f"{tmp_path}/s", "--domains", "literary", "--json"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["files"] == {"success": 1} and out["status"]["entities"] > 0
    assert main(["--store", f"{tmp_path}/s", "--search", "robert", "--stats", "--json"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["found"][0]["name"] == "Robert" and out["types"]["CHARACTER"] > 0


def test_command_line_asks_and_lists(spark, tmp_path, capsys, monkeypatch):
    import io
    import sys

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Maria met Robert. " * 30)
    (tmp_path / "in/b.xyz").write_text("?")
    assert main([f"{tmp_path}/in", "--batch", "--verbose", "--store", f"{tmp_path}/s", "--domains", "literary", "--json"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [v for k, v in out["refused"].items() if k.endswith("b.xyz")] == ["unsupported extension"]
    monkeypatch.setattr(sys, "stdin", io.StringIO("stats\nsearch maria\nwhat\nquit\nsearch robert\n"))
    assert main(["--store", f"{tmp_path}/s", "--interactive", "--quiet"]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert json.loads(lines[0])["CHARACTER"] > 0 and json.loads(lines[1])[0]["name"] == "Maria" and lines[2] == "stats, search NAME or quit" and len(lines) == 3
