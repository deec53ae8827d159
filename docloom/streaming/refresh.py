"""Refresh of a store from files that keep arriving, page results written as they come, and lines as documents.

A file source replaces a directory watcher: each micro-batch holds the new files, and the checkpoint makes every batch
count once, also after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.functions.text import cleanup_text


def watch(spark: SparkSession, path: str, schema: str, pattern: str = "*", form: str = "parquet") -> DataFrame:
    """A stream of the rows of files under ``path``, temporary names left out by the pattern."""
    return spark.readStream.schema(schema).format(form).option("pathGlobFilter", pattern).load(path)


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "2 seconds") -> StreamingQuery:
    """Run ``apply(rows, batch id)`` on every micro-batch; ``every=None`` takes what is there and ends."""
    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def append_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that may be repeated: a batch owns the partition of its id and overwrites it."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def lines_as_documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream in which every line of the arriving text files is one document."""
    rows = spark.readStream.text(path)
    return rows.select(F.sha2("value", 256).alias("doc_id"), cleanup_text(F.col("value")).alias("text")).where("text <> ''")


def windowed_counts(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by type in event-time windows, late rows dropped by watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings of files (path, modified): added, changed or deleted; unchanged files have no row.

    A store is reloaded from the first two and rid of the last; a listing per trigger replaces a watcher's events, and a
    file written several times between two listings counts once.
    """
    a, b = before.groupBy("path").agg(F.max("modified").alias("old")), after.groupBy("path").agg(F.max("modified").alias("new"))
    both = a.join(b, "path", "full")
    change = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("deleted")).when(F.col("old") != F.col("new"), F.lit("changed"))
    return both.select("path", change.alias("change")).where("change is not null")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified) of the files under ``path``; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"))


def settled(files: DataFrame, now: Column, quiet: str = "2 seconds") -> DataFrame:
    """Files that haven't been written to for a while; the others wait for the next listing."""
    return files.where(F.col("modified") <= now - F.expr(f"interval {quiet}"))
