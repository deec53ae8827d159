"""The property graph: nodes (id, node_type, entity_type, ...) and edges (source_id, target_id, relation_type, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import preview

EDGE_KEY = ("source_id", "target_id", "relation_type")


def contains_edges(chunks: DataFrame) -> DataFrame:
    """An edge from each chunk to each of its entities, with the first 200 characters as evidence."""
    return chunks.select(F.col("id").alias("source_id"), F.explode("entity_ids").alias("target_id"), F.lit("CONTAINS").alias("relation_type"), F.lit(1.0).alias("confidence"), preview(F.col("text"), 200).alias("evidence"), F.lit("structural").alias("discovery_method"))


def upsert_edges(edges: DataFrame, new: DataFrame, order: str = "created_at") -> DataFrame:
    """Edges unique by key, the latest kept."""
    rank = F.row_number().over(Window.partitionBy(*EDGE_KEY).orderBy(F.desc(order), F.desc("confidence")))
    return edges.unionByName(new, allowMissingColumns=True).withColumn("__n", rank).where("__n = 1").drop("__n")


def cross_chunk(chunks: DataFrame, entities: DataFrame, kind: str = "CHARACTER", types: tuple[str, ...] = ("CHARACTER", "LOCATION", "SCENE")) -> DataFrame:
    """Chunks and the entities of ``kind`` mentioned in them, as edges of confidence 0.8."""
    e = entities.where(F.col("type").isin(*types)).select(F.col("id").alias("target_id"), "type")
    pairs = chunks.select(F.col("id").alias("source_id"), F.explode("entity_ids").alias("target_id"))
    return pairs.join(e, "target_id").where(F.col("type") == kind).select("source_id", "target_id", F.lit("MENTIONED_WITH").alias("relation_type"), F.lit(0.8).alias("confidence"))


def edges_of(edges: DataFrame, node: str | int) -> DataFrame:
    """Outgoing, then incoming edges of a node; a loop shows once for each direction."""
    out = edges.where(F.col("source_id") == node).withColumn("direction", F.lit("outgoing"))
    return out.unionByName(edges.where(F.col("target_id") == node).withColumn("direction", F.lit("incoming")))


def within_hops(edges: DataFrame, starts: DataFrame, entities: DataFrame, hops: int = 2) -> DataFrame:
    """(start, id) for all entities at most ``hops`` undirected steps away through entities only; starts are left out.

    ``edges`` and ``entities`` may be of any size: each hop is one equi-join, and places seen before are dropped by an
    anti-join, so the frontier only holds new ones.
    """
    keep = entities.select("id").distinct()
    seen = starts.select(F.col("id").alias("start"), "id").distinct()
    front = seen.join(keep, "id", "left_semi").select("start", "id")
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    both = edges.select(F.explode(F.array(pair("source_id", "target_id"), pair("target_id", "source_id"))).alias("e")).select("e.a", "e.b")
    for _ in range(hops):
        # only edges at the frontier are looked at, by one equi-join over one reading of them; where they lead is filtered after
        step = front.join(both, front["id"] == both["a"]).select("start", F.col("b").alias("id")).distinct().join(keep, "id", "left_semi").select("start", "id")
        front = step.join(seen, ["start", "id"], "left_anti")
        seen = seen.union(front)
    return seen.where("start <> id")


def relation_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("relation_type", F.lit("unknown")).alias("relation_type")).agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def export_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("node_type") == "entity").alias("entities"), F.count_if(F.col("node_type") == "chunk").alias("chunks"))
    return n.join(edges.agg(F.count(F.lit(1)).alias("edges")))


def of_types(nodes: DataFrame, edges: DataFrame, types: list[str], most: int | None = 900) -> tuple[DataFrame, DataFrame]:
    """Nodes that are no entities or entities of the types, and edges with both ends among them, each once; cut to
    ``most`` (a display limit), nodes by id and edges by key.

    Edges lead to entities, which types thin out, so their targets are looked up first and few go on to the sources, by
    which what is left stays partitioned and loses its doubles without a further shuffle.  The ids are hashed: edges needn't be sorted, which would spill.
    """
    kept = nodes.where((F.col("node_type") != "entity") | F.col("entity_type").isin(*types))
    ids = kept.select("id").hint("shuffle_hash")
    e = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").dropDuplicates([*EDGE_KEY])
    return (kept, e) if most is None else (kept.orderBy("id").limit(most), e.orderBy(*EDGE_KEY).limit(most))


def with_description(nodes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Nodes with new descriptions (id, text) appended to their list."""
    new = descriptions.groupBy("id").agg(F.sort_array(F.collect_list("text")).alias("new"))
    return nodes.join(new, "id", "left").withColumn("descriptions", F.concat(F.coalesce("descriptions", F.array().cast("array<string>")), F.coalesce("new", F.array().cast("array<string>")))).drop("new")


def upsert_nodes(nodes: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """Nodes unique by id; of several the latest is kept, of equally late ones the new."""
    from docloom.operators.store import upsert

    return upsert(nodes, new, "id", order)


def edge_id() -> Column:
    return F.concat_ws("--", "source_id", "relation_type", "target_id")


def edge_by_id(edges: DataFrame, wanted: str) -> DataFrame:
    """The edge of one id (source--type--target); no row if there is none."""
    return edges.withColumn("id", edge_id()).where(F.col("id") == wanted)


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, json) for every node and edge, an object of its fields without nulls, and one row of counts."""
    flat = lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "true"}).alias("json")
    counts = export_counts(nodes, edges)
    out = nodes.select(F.lit("node").alias("part"), F.col("id").cast("string").alias("id"), flat(nodes))
    return out.unionByName(edges.select(F.lit("edge").alias("part"), edge_id().alias("id"), flat(edges))).unionByName(counts.select(F.lit("counts").alias("part"), F.lit("").alias("id"), flat(counts)))


def view(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, most: int = 900) -> DataFrame:
    """One row about what the graph endpoint shows: nodes and edges shown, whether either was cut at ``most`` (a display
    limit), and the types there are to filter by."""
    kept, own = of_types(nodes, edges, types, most=None) if types is not None else (nodes, edges)
    n = kept.agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("nodes"), (F.count(F.lit(1)) > most).alias("nodes_truncated"))
    e = own.agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("edges"), (F.count(F.lit(1)) > most).alias("edges_truncated"))
    t = nodes.where("node_type = 'entity'").agg(F.array_join(F.array_sort(F.collect_set("entity_type")), "|").alias("types"))
    return n.join(e).join(t)  # three single rows


def json_value(data: Column) -> Column:
    """Node data as JSON: objects as they are; other JSON under ``value``, and what isn't JSON under ``raw``."""
    is_json = F.try_parse_json(data).isNotNull()
    return F.when(is_json & data.rlike(r"^\s*\{"), data).when(is_json, F.concat(F.lit('{"value":'), F.trim(data), F.lit("}"))).when(data.isNotNull(), F.to_json(F.struct(data.alias("raw"))))


def node_link_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, id, line): the graph as one node-link object whose nodes and links have a line each.

    Lines in the order of (ord, id) make a valid file, written and read in parallel; nulls are left out.  A comma ends
    all lines but those of the greatest node and link.
    """
    text = lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "true"})
    links = edges.withColumnsRenamed({"source_id": "source", "target_id": "target"})

    def lines(df: DataFrame, key: Column, ord: int) -> DataFrame:
        rows = df.select(F.lit(ord).alias("ord"), key.cast("string").alias("id"), text(df).alias("json"))
        last = F.broadcast(rows.agg(F.max("id").alias("last")))
        return rows.join(last).select("ord", "id", F.concat("json", F.when(F.col("id") < F.col("last"), F.lit(",")).otherwise(F.lit(""))).alias("line"))

    fixed = [(0, "", '{"directed":true,"multigraph":false,"graph":{},"nodes":['), (2, "", '],"links":['), (4, "", "]}")]
    out = nodes.sparkSession.createDataFrame(fixed, "ord int, id string, line string")
    return out.unionByName(lines(nodes, F.col("id"), 1)).unionByName(lines(links, F.concat_ws("--", "source", "relation_type", "target"), 3))


def read_graph(spark: SparkSession, path: str, node_schema: str, edge_schema: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored graph: from ``graph.json`` (a node-link object, with a line per node and link or not),
    else from ``graph.graphml``, else empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    there = lambda f: (lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))(hadoop.Path(f"{path}/{f}"))
    if there("graph.json"):
        whole = spark.read.schema(f"nodes array<struct<{_colons(node_schema)}>>, links array<struct<source: string, target: string, {_colons(edge_schema)}>>").option("multiLine", "true").json(f"{path}/graph.json")
        edges = whole.select(F.explode("links").alias("e")).select("e.*").withColumnsRenamed({"source": "source_id", "target": "target_id"})
        return whole.select(F.explode("nodes").alias("n")).select("n.*"), edges
    empty = spark.createDataFrame([], node_schema), spark.createDataFrame([], f"source_id string, target_id string, {edge_schema}")
    if not there("graph.graphml"):
        return empty
    out = []
    for tag, frame in (("node", empty[0]), ("edge", empty[1])):
        ends = "" if tag == "node" else "_source string, _target string, "
        ident = "_id string, " if tag == "node" else ""
        rows = spark.read.format("xml").option("rowTag", tag).schema(f"{ident}{ends}data array<struct<_VALUE: string, _key: string>>").load(f"{path}/graph.graphml")
        of = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE:string,_key:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"])))
        fixed = {"id": F.col("_id") if tag == "node" else None, "source_id": F.col("_source") if tag == "edge" else None, "target_id": F.col("_target") if tag == "edge" else None}
        cols = [(fixed[f.name] if fixed.get(f.name) is not None else F.try_element_at(of, F.lit(f.name)).cast(f.dataType)).alias(f.name) for f in frame.schema.fields]
        out.append(rows.select(cols))
    return out[0], out[1]


def _colons(schema: str) -> str:
    return ", ".join(": ".join(part.strip().split(None, 1)) for part in schema.split(","))


def node_link_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as lines of JSON, nodes then links, nulls left out; a writer joins them to one node-link object."""
    a = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))
    return a.unionByName(edges.select(F.lit("link").alias("part"), F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json")))
