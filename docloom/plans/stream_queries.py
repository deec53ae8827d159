"""Queries on Markdown and on incremental refresh."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.markdown import to_plain
from docloom.plans.catalog import query, squeeze_sql, table, trim_sql
from docloom.streaming.refresh import append_once, each_batch, watch


def _shared(spark: SparkSession) -> str:
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="docloom-")
    atexit.register(shutil.rmtree, own, True)
    return "file://" + own


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files into an append-only table, and counted there."""
    at = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    each_batch(stream, append_once(f"{at}/rows", ["event_id"]), f"{at}/state", every=None).awaitTermination()
    rows = spark.read.parquet(f"{at}/rows")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_CELL = squeeze_sql("replace(text, '|', ' ')")
_PLAIN = "l"
for _from, _to in ((r"\*\*(.*?)\*\*", r"\1"), (r"\*(.*?)\*", r"\1"), (r"\[(.*?)\]\(.*?\)", r"\1"), (r"^#+\s*", ""), ("`([^`]*)`", r"\1")):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_from}', '{_to}', 'g')"
_BODY = f"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: {trim_sql(_PLAIN)}), lambda l: l <> ''), chr(10))"


@query(f"""SELECT conv_id * 1000 + turn AS doc_id, 'Head ' || role || chr(10) || 'key: ' || role || '; value: ' || {_CELL} || chr(10) || 'after *it*' || chr(10) || 'see link and code ' || role
|| coalesce(chr(10) || nullif({_BODY}, ''), '') AS text FROM conversations""")
def md_to_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.functions.text import squeeze

    cell = squeeze(F.replace("text", F.lit("|"), F.lit(" ")))
    text = F.concat(F.lit("## Head **"), "role", F.lit("**\n\n| key | value |\n|---|---|\n| "), "role", F.lit(" | "), cell, F.lit(" |\n  after *it*\nsee [link](http://x) and `code` *"), "role", F.lit("*\n \n"), "text")
    return to_plain(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), text.alias("text")))


__all__ = ["watch"]
