"""Sinks: chunk and page files, graph exports, logs of model calls, stage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import doc_name, preview


def write_chunk_files(chunks: DataFrame, path: str) -> None:
    """One text column per chunk, foldered by document; a chunk's rows carry its header line and text."""
    rows = chunks.select(doc_name(F.col("doc_id").cast("string")).alias("document"), F.format_string("chunk_%03d", "chunk_id").alias("chunk"), "text")
    rows.write.mode("overwrite").partitionBy("document", "chunk").text(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Page results foldered by document, as Parquet; what is there of other documents stays."""
    pages.withColumn("document", doc_name(F.col("doc_id").cast("string"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document").parquet(path)


def write_sections(sections: DataFrame, path: str) -> None:
    """Section texts with their title, level and range, foldered by document."""
    write_pages(sections, path)


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of GraphML (ord, line): nulls left out, scalars as they are, anything nested as JSON."""

    def data(df: DataFrame, skip: tuple[str, ...]) -> Column:
        parts = []
        for f in df.schema.fields:
            if f.name not in skip:
                nested = f.dataType.typeName() in ("array", "map", "struct")
                v = F.to_json(F.col(f.name)) if nested else F.col(f.name).cast("string")
                parts.append(F.coalesce(F.concat(F.lit(f'<data key="{f.name}">'), _escape(v), F.lit("</data>")), F.lit("")))
        return F.concat(*parts) if parts else F.lit("")

    head = nodes.sparkSession.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "ord int, line string")
    q = lambda c: _escape(F.col(c).cast("string"))
    n = nodes.select(F.lit(1).alias("ord"), F.concat(F.lit('<node id="'), q("id"), F.lit('">'), data(nodes, ("id",)), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("ord"), F.concat(F.lit('<edge source="'), q("source_id"), F.lit('" target="'), q("target_id"), F.lit('">'), data(edges, ("source_id", "target_id")), F.lit("</edge>")).alias("line"))
    return head.unionByName(n).unionByName(e)


def call_log(calls: DataFrame, path: str) -> None:
    """Append model calls (prompt, reply, error) with their time and short previews."""
    rows = calls.withColumns({"called_at": F.current_timestamp(), "prompt_preview": preview(F.col("prompt"), 200), "prompt_length": F.length("prompt"), "reply_length": F.length("reply")})
    rows.write.mode("append").parquet(path)


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """Candidates of tables of contents by category and how their end was found."""
    return candidates.groupBy("category", "end_method").agg(F.count(F.lit(1)).alias("n"))
