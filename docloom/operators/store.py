"""The entity store: tables of entities, chunks and edges with upsert, update, delete, search and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import trim_u
from docloom.functions.vectors import rounded, similarity
from docloom.operators.search import PLACES


def upsert(table: DataFrame, new: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """Rows unique by key, the latest kept; of equally late ones the new."""
    both = table.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("__new")))
    return both.withColumn("__n", rank).where("__n = 1").drop("__n", "__new")


def update(table: DataFrame, changes: DataFrame, key: str = "id", now: Column | None = None) -> DataFrame:
    """Fields of ``changes`` that aren't null replace those of the row; confidence is kept within 0 and 1."""
    fields = [c for c in changes.columns if c != key]
    c = changes.select(key, *(F.col(f).alias(f"__{f}") for f in fields), F.lit(True).alias("__hit"))
    rows = table.join(c, key, "left")
    new = {f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}
    if "confidence" in new:
        new["confidence"] = F.greatest(F.lit(0.0), F.least(F.lit(1.0), new["confidence"]))
    if now is not None and "updated_at" in table.columns:
        new["updated_at"] = F.when(F.col("__hit"), now).otherwise(F.col("updated_at"))
    return rows.withColumns(new).select(*table.columns)


def delete(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities without those of ``gone`` (id), and edges without any end among them."""
    e = edges
    for end in ("source_id", "target_id"):
        e = e.join(gone.select(F.col("id").alias(end)), end, "left_anti")
    return entities.join(gone.select("id"), "id", "left_anti"), e


def create_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """New edges whose ends exist, with an id, confidence within 0 and 1 (missing or 0 means 1)."""
    for end in ("source_id", "target_id"):
        edges = edges.join(entities.select(F.col("id").alias(end)), end, "left_semi")
    c = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    return edges.withColumns({"confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), "id": F.concat_ws("--", "source_id", "relation_type", "target_id")})


def page(table: DataFrame, order: list[str], offset: int = 0, limit: int = 50, most: int = 200) -> DataFrame:
    return table.orderBy(*order).offset(max(0, offset)).limit(min(limit, most))


def of_type(entities: DataFrame, kind: str, exact: bool = False) -> DataFrame:
    return entities.where(F.col("type") == kind) if exact else entities.where(F.upper("type") == kind.upper())


def search_names(entities: DataFrame, query: str, limit: int = 10, order: str = "id") -> DataFrame:
    """Entities whose name holds the query, else those with an alias that does; scored by the share of it they cover."""
    q = query.strip().lower()
    if not q:
        return entities.withColumn("score", F.lit(0.0)).limit(0)
    alias = F.try_element_at(F.filter("aliases", lambda a: F.contains(F.lower(a), F.lit(q))), F.lit(1))
    hit = F.when(F.contains(F.lower("name"), F.lit(q)), F.length("name")).otherwise(F.length(alias))
    rows = entities.withColumn("score", rounded(F.lit(float(len(q))) / hit, PLACES)).where("score is not null")
    return rows.orderBy(F.desc("score"), order).limit(limit)


def search_vectors(entities: DataFrame, query: list[float], kind: str | None = None, least: float = 0.6, limit: int = 10) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = entities.where(F.col("type") == kind) if kind else entities
    rows = rows.withColumn("score", rounded(similarity(F.col("embedding"), q), PLACES)).where(F.col("score") >= least)
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def type_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def filter_edges(edges: DataFrame, entity: str | int | None = None, kind: str | None = None) -> DataFrame:
    if entity is not None:
        edges = edges.where((F.col("source_id") == entity) | (F.col("target_id") == entity))
    return edges.where(F.upper("relation_type") == kind.upper()) if kind is not None else edges


def named_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of their ends (the id where there is no entity), defaults for what is missing.

    The names are hashed, so that the edges needn't be sorted twice, which would spill.
    """
    n = entities.select("id", "name").hint("shuffle_hash")
    for end in ("source", "target"):
        edges = edges.join(n.withColumnsRenamed({"id": f"{end}_id", "name": f"{end}_name"}), f"{end}_id", "left")
        edges = edges.withColumn(f"{end}_name", F.coalesce(f"{end}_name", F.col(f"{end}_id").cast("string")))
    return edges.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def context_analysis(hits: DataFrame, entities: DataFrame, edges: DataFrame, places: int = 3) -> DataFrame:
    """For found entities (id, score): a line about each and lines for its relations to other entities, best first."""
    found = hits.join(entities.select("id", "name", "description"), "id")
    named = named_edges(edges.join(entities.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(entities.select(F.col("id").alias("target_id")), "target_id", "left_semi"), entities)
    line = F.concat_ws(" ", "source_name", "relation_type", "target_name")
    ends = named.select(F.col("source_id").alias("id"), line.alias("line")).union(named.select(F.col("target_id"), line)).distinct()
    lines = ends.join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("relations"))
    return found.join(lines, "id", "left").select("id", F.round("score", places).alias("score"), F.concat_ws(" - ", "name", F.nullif(F.col("description"), F.lit(""))).alias("line"), F.coalesce("relations", F.array().cast("array<string>")).alias("relations"))


def context_prompt(analysis: DataFrame) -> DataFrame:
    """The same as one text, best first, with its counts."""
    a = F.struct((-F.col("score")).alias("s"), "id", F.concat_ws("\n", "line", F.array_join("relations", "\n")).alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(a)), lambda x: x["t"]), "\n")
    return analysis.agg(text.alias("prompt"), F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum(F.size("relations")), F.lit(0)).alias("relations"))


def embedding_texts(entities: DataFrame) -> DataFrame:
    """What is embedded of an entity: its name with its type, and these with description and context."""
    return entities.withColumns({"name_text": F.concat_ws(" ", "name", "type"), "context_text": F.concat_ws(" ", "name", "type", "description", "context")})


def contextual_entities(hits: DataFrame, entities: DataFrame, most: int = 10, aliases: int = 10) -> DataFrame:
    """Found entities (id, score) as extraction prompts want them, best first."""
    rows = hits.join(entities, "id").orderBy(F.desc("score"), "id").limit(most)
    return rows.select("id", "name", "type", F.slice("aliases", 1, aliases).alias("aliases"), "description", "confidence")


def card(entities: DataFrame, edges: DataFrame, node: str | int, most_edges: int = 20, most_related: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One entity's row, its first edges with their direction, and its first related entities two hops away."""
    from docloom.operators.graph import EDGE_KEY, edges_of, within_hops

    own = entities.where(F.col("id") == node)
    related = within_hops(edges, own, entities).select("id").join(entities.select("id", "name", "type"), "id").orderBy("id")
    return own, edges_of(edges, node).orderBy(*EDGE_KEY, "direction").limit(most_edges), related.limit(most_related)


def status(entities: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    return one(entities, "entities").join(one(chunks, "chunks")).join(one(edges, "relations"))


def by_id(table: DataFrame, wanted: str | int, key: str = "id") -> DataFrame:
    """The row of one id; no row if there is none."""
    return table.where(F.col(key) == wanted)


def response(entities: DataFrame) -> DataFrame:
    """Entities as the service answers them: the public fields only, ``source_chunk_ids`` under ``source_chunks``."""
    return entities.withColumnRenamed("source_chunk_ids", "source_chunks").select("id", "name", "type", "description", "confidence", "aliases", "source_chunks")


def create_entities(new: DataFrame, now: Column | None = None) -> DataFrame:
    """New entities with an id from their content, confidence within 0 and 1 (missing or 0 means 1), and times."""
    c = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    rows = new.withColumns({"id": F.sha2(F.concat_ws("\u0001", "name", "type"), 256), "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))})
    return rows if now is None else rows.withColumns({"created_at": now, "updated_at": now})


def register_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (id or null, text, document_source, start, end) as the store keeps them; an id is made where none is given."""
    made = F.sha2(F.concat_ws("\u0001", "document_source", F.col("start").cast("string"), F.col("end").cast("string")), 256)
    return chunks.withColumns({"id": F.coalesce("id", made), "entity_ids": F.array().cast("array<string>"), "processed": F.lit(False)})


def persist_chunks(registered: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registered chunks with the ids of their entities (found: id, entity_ids), marked processed, and the edges to these."""
    from docloom.operators.graph import contains_edges

    f = found.select("id", F.array_sort(F.array_distinct("entity_ids")).alias("__ids"))
    rows = registered.join(f, "id", "left")
    done = rows.withColumns({"entity_ids": F.coalesce("__ids", F.col("entity_ids")), "processed": F.col("processed") | F.col("__ids").isNotNull()}).drop("__ids")
    return done, contains_edges(done)


def edge_list(edges: DataFrame, entity: str | int | None = None, kind: str | None = None, order: tuple[str, ...] = ("source_id", "target_id"), offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the filtered edges, each row with ``total_found`` and ``returned``."""
    found = filter_edges(edges, entity, kind)
    total = found.agg(F.count(F.lit(1)).alias("total_found"))
    shown = F.greatest(F.lit(0), F.least(F.lit(min(limit, 200)).cast("long"), F.col("total_found") - max(0, offset)))
    return page(found, list(order), offset, limit).join(F.broadcast(total)).withColumn("returned", shown)


def analysis_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities by type, edges by relation, and the totals, as (kind, name, n)."""
    count = F.count(F.lit(1)).alias("n")
    a = entities.groupBy(F.col("type").alias("name")).agg(count).select(F.lit("type").alias("kind"), "name", "n")
    b = edges.groupBy(F.col("relation_type").alias("name")).agg(count).select(F.lit("relation"), "name", "n")
    total = lambda df, name: df.agg(count).select(F.lit("total"), F.lit(name), "n")
    return a.union(b).union(total(entities, "entities")).union(total(edges, "relations"))


def growth(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, before, after, added) of two tables of counts (name, n)."""
    both = before.withColumnRenamed("n", "before").join(after.withColumnRenamed("n", "after"), "name", "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("before", "after")})
    return both.withColumn("added", F.col("after") - F.col("before"))


def details(entities: DataFrame, edges: DataFrame, node: str | int, most_edges: int = 20, most_related: int = 10) -> DataFrame:
    """The answer about one entity as rows (part, place, id, text): itself, its first edges, its first related entities, and
    a row of metadata with the numbers of both.  No row if there is no such entity."""
    own, first, related = card(entities, edges, node, most_edges, most_related)
    number = lambda *c: F.row_number().over(Window.orderBy(*c))  # noqa: E731 - over at most most_edges rows
    a = own.select(F.lit("entity").alias("part"), F.lit(1).alias("place"), F.col("id").cast("string").alias("id"), F.concat_ws(" ", "name", "type").alias("text"))
    b = first.select(F.lit("edge"), number("source_id", "target_id", "relation_type", "direction"), F.concat_ws("--", "source_id", "relation_type", "target_id"), F.col("direction"))
    c = related.select(F.lit("related"), number("id"), F.col("id").cast("string"), F.concat_ws(" ", "name", "type"))
    rows = a.union(b).union(c)
    meta = rows.groupBy().agg(F.count_if(F.col("part") == "edge").alias("e"), F.count_if(F.col("part") == "related").alias("r"), F.count(F.lit(1)).alias("n")).where("n > 0")
    return rows.union(meta.select(F.lit("metadata"), F.lit(1), F.lit(str(node)), F.concat_ws(" ", F.col("e").cast("string"), F.col("r").cast("string"))))


def knowledge_export(entities: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph as rows (section, key, json): metadata, entities, chunks, graph and statistics, nulls left out."""
    text = lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "true"}).alias("json")
    part = lambda df, name, key: df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), text(df))
    counts = status(entities, chunks, edges)
    meta = counts.select(F.lit("2.0").alias("version"), (F.col("entities") + F.col("chunks")).alias("nodes"), F.col("relations").alias("links"))
    out = part(meta, "metadata", F.lit("")).union(part(entities, "entities", F.col("id"))).union(part(chunks, "chunks", F.col("id")))
    out = out.union(part(edges, "graph", F.concat_ws("--", "source_id", "relation_type", "target_id")))
    stats = analysis_stats(entities, edges)
    return out.union(part(stats, "statistics", F.concat_ws("/", "kind", "name")))


# --- tables on disk ---------------------------------------------------------------------------


class Store:
    """Tables under one path; every save is a new version, so readers never see half a write and backups cost nothing."""

    TABLES = ("entities", "chunks", "edges", "embedding_cache", "metadata")

    def __init__(self, spark: SparkSession, path: str, keep: int = 5):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        p = hadoop.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def versions(self, table: str) -> list[int]:
        """Complete versions, oldest first."""
        fs, hadoop = self._fs()
        at = hadoop.Path(f"{self.path}/{table}")
        if not fs.exists(at):
            return []
        found = [int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v=")]
        return sorted(v for v in found if fs.exists(hadoop.Path(f"{self.path}/{table}/v={v}/_SUCCESS")))

    def save(self, table: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        v = (self.versions(table) or [0])[-1] + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{self.path}/{table}/v={v}")
        self.prune(table)
        return v

    def load(self, table: str, version: int | None = None) -> DataFrame | None:
        have = self.versions(table)
        v = version if version is not None else (have[-1] if have else None)
        return self.spark.read.parquet(f"{self.path}/{table}/v={v}") if v in have else None

    def open(self, schemas: dict[str, str]) -> dict[str, DataFrame]:
        """All tables at their latest versions, read when they are used; one that isn't there is empty."""
        out = {}
        for t, schema in schemas.items():
            have = self.load(t)
            out[t] = self.spark.createDataFrame([], schema) if have is None else have
        return out

    def metadata(self) -> DataFrame:
        """The row of metadata; a row without values if none is stored."""
        have = self.load("metadata")
        return self.spark.createDataFrame([(None, None)], "last_saved timestamp, storage_version string") if have is None else have

    def one(self, table: str, wanted: str | int) -> DataFrame | None:
        """One entity or chunk by id, from the latest version."""
        have = self.load(table)
        return None if have is None else by_id(have, wanted)

    def restore(self, table: str, version: int) -> int:
        """Make an older version the latest."""
        old = self.load(table, version)
        if old is None:
            raise ValueError(f"no version {version} of {table}")
        return self.save(table, old)

    def prune(self, table: str) -> None:
        fs, hadoop = self._fs()
        have = self.versions(table)
        for v in have[: len(have) - max(1, self.keep)]:  # the latest always stays
            fs.delete(hadoop.Path(f"{self.path}/{table}/v={v}"), True)

    def merge(self, table: str, new: DataFrame, **how: str) -> int:
        old = self.load(table)
        return self.save(table, new if old is None else upsert(old, new, **how))

    def sizes(self) -> dict[str, tuple[int, int]]:
        """(files, bytes) of each table."""
        fs, hadoop = self._fs()
        out = {}
        for t in self.TABLES:
            p = hadoop.Path(f"{self.path}/{t}")
            if fs.exists(p):
                s = fs.getContentSummary(p)
                out[t] = (int(s.getFileCount()), int(s.getLength()))
        return out


def read_json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows from files of one JSON object each; files that don't fit the schema are skipped."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", "true").json(path)
    return rows.where("_corrupt_record is null").drop("_corrupt_record")


def backups_to_drop(backups: DataFrame, keep: int = 5) -> DataFrame:
    """Of (name, created_at) all but the newest ``keep``."""
    rank = F.row_number().over(Window.orderBy(F.desc("created_at"), "name"))
    return backups.withColumn("__n", rank).where(F.col("__n") > keep).drop("__n")


__all__ = ["Store", "trim_u"]
