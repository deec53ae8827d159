"""The whole pipeline: documents to chunks, entities, edges and a stored knowledge graph, in restartable stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import chunking, extraction
from docloom.operators.domains import domain
from docloom.operators.graph import contains_edges, node_link_json
from docloom.operators.providers import Extractor
from docloom.operators.store import Store, status


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; made first if it isn't complete (its ``_SUCCESS`` is the proof)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    done = hadoop.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@dataclass
class Knowledge:
    chunks: DataFrame
    entities: DataFrame
    edges: DataFrame

    def status(self) -> DataFrame:
        return status(self.entities, self.chunks, self.edges)

    def export(self) -> DataFrame:
        nodes = self.entities.select("id", F.lit("entity").alias("node_type"), F.col("type").alias("entity_type"), "name").unionByName(self.chunks.select("id", F.lit("chunk").alias("node_type"), F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("name")))
        return node_link_json(nodes, self.edges)


def build(spark: SparkSession, docs: DataFrame, path: str, domains: list[str] | None = None, extractor: Extractor | None = None, **chunk_settings: object) -> Knowledge:
    """Documents (doc_id, text) to a knowledge graph whose stages are tables under ``path``.

    Entities are not merged across chunks: each mention is a row with an id from its content, so a stage that runs
    twice writes the same rows.
    """
    names = domains or ["simple"]
    types = sorted({t for n in names for t in domain(n).types})

    def make_chunks() -> DataFrame:
        c = chunking.chunk(docs.select("doc_id", "text"), names, **chunk_settings)
        return c.withColumn("id", extraction.entity_id("doc_id", "chunk_id", "start"))

    chunks = stage(spark, f"{path}/chunks", make_chunks)

    def make_entities() -> DataFrame:
        found = extraction.mentions(chunks.select(F.col("id").alias("source_chunk_id"), "doc_id", "chunk_id", "text"), extractor)
        good = extraction.second_gate(extraction.validate(found, types))
        return good.withColumn("id", extraction.entity_id("source_chunk_id", "ord", "name", "type"))

    entities = stage(spark, f"{path}/entities", make_entities)

    def make_edges() -> DataFrame:
        own = entities.groupBy(F.col("source_chunk_id").alias("id")).agg(F.collect_set("id").alias("entity_ids"))
        return contains_edges(chunks.select("id", "text").join(own, "id"))

    return Knowledge(chunks, entities, stage(spark, f"{path}/edges", make_edges))


def save(spark: SparkSession, graph: Knowledge, path: str, keep: int = 5) -> Store:
    """The graph as a new version of a store."""
    s = Store(spark, path, keep)
    for name in ("entities", "chunks", "edges"):
        s.save(name, getattr(graph, name))
    s.save("metadata", graph.status().withColumns({"last_saved": F.current_timestamp(), "storage_version": F.lit("2.0")}))
    return s
