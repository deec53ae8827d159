"""Queries on the store and the graph: parts and suppliers are entities, orders are chunks that hold parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import graph as G
from docloom.operators import store as S
from docloom.plans.catalog import query, table
from docloom.plans.vector_queries import DOT, _query


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.array("p_brand").alias("aliases"), F.col("p_size").alias("updated_at"), (F.col("p_size") / 50.0).alias("confidence"), F.lit(None).cast("string").alias("description"))


PARTS = "SELECT p_partkey AS id, p_name AS name, p_type AS type, p_brand AS alias, p_size AS updated_at, p_size / 50.0 AS confidence FROM part"


@query(f"SELECT id, name, type FROM ({PARTS}) ORDER BY name, id LIMIT 50 OFFSET 100")
def entity_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page(parts(spark, sf_dir), ["name", "id"], 100, 50).select("id", "name", "type")


@query(f"SELECT id, name FROM ({PARTS}) WHERE upper(type) = 'ECONOMY'")
def entity_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.of_type(parts(spark, sf_dir), "economy").select("id", "name")


@query(f"""WITH e AS ({PARTS}), s AS (SELECT id, name, round(CASE WHEN contains(lower(name), 'ring') THEN 4.0 / length(name) WHEN contains(lower(alias), 'ring') THEN 4.0 / length(alias) END, 9) AS score FROM e)
SELECT id, name, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 10""")
def entity_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_names(parts(spark, sf_dir), " Ring ").select("id", "name", "score")


@query(f"""WITH e AS ({PARTS}), s AS (SELECT id, name, round(CASE WHEN contains(lower(name), 'brand#1') THEN 7.0 / length(name) WHEN contains(lower(alias), 'brand#1') THEN 7.0 / length(alias) END, 9) AS score FROM e)
SELECT id, name, score FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 10""")
def entity_alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_names(parts(spark, sf_dir), "Brand#1").select("id", "name", "score")


@query(f"SELECT type, count(*) AS n FROM ({PARTS}) GROUP BY type")
def entity_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.type_counts(parts(spark, sf_dir))


@query(f"SELECT id, CASE WHEN updated_at > 25 THEN name || '!' ELSE name END AS name, CAST(CASE WHEN updated_at > 25 THEN 1.0 ELSE confidence END AS DOUBLE) AS confidence FROM ({PARTS})")
def entity_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    big = F.col("updated_at") > 25
    changes = p.select("id", F.when(big, F.concat("name", F.lit("!"))).alias("name"), F.when(big, F.lit(3.0)).alias("confidence"))
    return S.update(p, changes).select("id", "name", "confidence")


@query(f"SELECT id, CASE WHEN updated_at <= 25 THEN name || ' v2' ELSE name END AS name FROM ({PARTS})")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    return S.upsert(p, p.withColumns({"name": F.concat("name", F.lit(" v2")), "updated_at": F.lit(25)})).select("id", "name")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders contain parts; suppliers supply parts."""
    li = table(spark, sf_dir, "lineitem")
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    pairs = lambda c: li.select(c, "l_partkey").distinct()  # noqa: E731 - numbers take less than ids
    a = pairs("l_orderkey").select(key("o", "l_orderkey").alias("source_id"), key("p", "l_partkey").alias("target_id"), F.lit("CONTAINS").alias("relation_type"))
    return a.union(pairs("l_suppkey").select(key("s", "l_suppkey"), key("p", "l_partkey"), F.lit("SUPPLIES")))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with doubles, by one reading: for what drops doubles once few edges are left."""
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    edge = lambda k, c, kind: F.struct(key(k, c).alias("source_id"), key("p", "l_partkey").alias("target_id"), F.lit(kind).alias("relation_type"))
    both = F.explode(F.array(edge("o", "l_orderkey", "CONTAINS"), edge("s", "l_suppkey", "SUPPLIES"))).alias("e")
    return table(spark, sf_dir, "lineitem").select(both).select("e.*")


EDGES = """SELECT DISTINCT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id, 'CONTAINS' AS relation_type FROM lineitem
UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'SUPPLIES' FROM lineitem"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t, k, c, kind, typ, name: table(spark, sf_dir, t).select(F.concat(F.lit(k), F.col(c).cast("string")).alias("id"), F.lit(kind).alias("node_type"), typ.alias("entity_type"), name.alias("name"))
    none = F.lit(None).cast("string")
    return n("orders", "o", "o_orderkey", "chunk", none, none).union(n("part", "p", "p_partkey", "entity", F.col("p_type"), F.col("p_name"))).union(n("supplier", "s", "s_suppkey", "entity", F.lit("SUPPLIER"), F.col("s_name")))


NODES = """SELECT 'o' || o_orderkey AS id, 'chunk' AS node_type, NULL AS entity_type, NULL AS name FROM orders
UNION ALL SELECT 'p' || p_partkey, 'entity', p_type, p_name FROM part UNION ALL SELECT 's' || s_suppkey, 'entity', 'SUPPLIER', s_name FROM supplier"""


@query("SELECT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id, 'CONTAINS' AS relation_type, CAST(1.0 AS DOUBLE) AS confidence FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    chunks = li.groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("entity_ids"))
    chunks = chunks.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), "entity_ids", F.lit("").alias("text"))
    return G.contains_edges(chunks).select("source_id", "target_id", "relation_type", F.col("confidence").cast("double").alias("confidence"))


@query(f"SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM ({EDGES}) UNION ALL SELECT target_id FROM ({EDGES})) GROUP BY id")
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(edges(spark, sf_dir))


@query(f"SELECT relation_type, count(*) AS n FROM ({EDGES}) GROUP BY relation_type")
def graph_relation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relation_stats(edges(spark, sf_dir))


@query(f"SELECT source_id, target_id, relation_type, 'incoming' AS direction FROM ({EDGES}) WHERE target_id = 'p7' UNION ALL SELECT source_id, target_id, relation_type, 'outgoing' FROM ({EDGES}) WHERE source_id = 'p7'")
def graph_entity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges_of(edges(spark, sf_dir), "p7")


@query(f"""WITH e AS ({EDGES}), n AS (SELECT id FROM ({NODES}) WHERE node_type = 'entity'),
b AS (SELECT source_id AS a, target_id AS b FROM e UNION SELECT target_id, source_id FROM e), k AS (SELECT * FROM b WHERE a IN (FROM n) AND b IN (FROM n)),
h1 AS (SELECT DISTINCT b AS id FROM k WHERE a = 's3'), h2 AS (SELECT DISTINCT k.b AS id FROM h1 JOIN k ON k.a = h1.id)
SELECT 's3' AS start, id FROM (FROM h1 UNION FROM h2) WHERE id <> 's3'""")
def graph_khop2(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("node_type = 'entity'")
    return G.within_hops(edges(spark, sf_dir), n.where("id = 's3'"), n, 2)


@query(f"SELECT count(*) AS nodes, count(*) FILTER (node_type = 'entity') AS entities, count(*) FILTER (node_type = 'chunk') AS chunks, (SELECT count(*) FROM ({EDGES})) AS edges FROM ({NODES})")
def graph_export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.export_counts(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH n AS ({NODES}), k AS (SELECT id FROM n WHERE node_type <> 'entity' OR entity_type IN ('ECONOMY', 'SUPPLIER'))
SELECT source_id, target_id, relation_type FROM ({EDGES}) WHERE source_id IN (FROM k) AND target_id IN (FROM k)""")
def graph_type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.of_types(nodes(spark, sf_dir), raw_edges(spark, sf_dir), ["ECONOMY", "SUPPLIER"], most=None)[1].select("source_id", "target_id", "relation_type")


@query(f"""WITH n AS ({NODES}), k AS (SELECT id FROM n WHERE node_type <> 'entity' OR entity_type IN ('ECONOMY', 'SUPPLIER'))
SELECT id, node_type FROM n WHERE id IN (FROM k) ORDER BY id LIMIT 900""")
def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the graph endpoint shows: 900 nodes at most."""
    return G.of_types(nodes(spark, sf_dir), edges(spark, sf_dir), ["ECONOMY", "SUPPLIER"])[0].select("id", "node_type")


@query("""SELECT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id, 'MENTIONED_WITH' AS relation_type, CAST(0.8 AS DOUBLE) AS confidence
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY'""")
def graph_cross_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = nodes(spark, sf_dir).where("node_type = 'entity'").select("id", F.col("entity_type").alias("type"))
    chunks = edges(spark, sf_dir).where("relation_type = 'CONTAINS'").select(F.col("source_id").alias("id"), F.array("target_id").alias("entity_ids"))
    return G.cross_chunk(chunks, p, "ECONOMY", ("ECONOMY", "STANDARD", "PROMO")).select("source_id", "target_id", "relation_type", F.col("confidence").cast("double").alias("confidence"))


@query(f"""WITH e AS ({EDGES}), gone AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_type = 'ECONOMY')
SELECT relation_type, count(*) AS n FROM e WHERE source_id NOT IN (FROM gone) AND target_id NOT IN (FROM gone) GROUP BY relation_type""")
def entity_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    left = S.delete(n, edges(spark, sf_dir), n.where("entity_type = 'ECONOMY'"))[1]
    return G.relation_stats(left)


@query(f"SELECT * FROM ({EDGES}) WHERE (source_id = 's3' OR target_id = 's3') AND upper(relation_type) = 'SUPPLIES' ORDER BY source_id, target_id LIMIT 25 OFFSET 5")
def relations_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page(S.filter_edges(edges(spark, sf_dir), "s3", "supplies"), ["source_id", "target_id"], 5, 25)


@query(f"""SELECT source_id, target_id, relation_type, coalesce(a.name, source_id) AS source_name, coalesce(b.name, target_id) AS target_name, CAST(0.0 AS DOUBLE) AS confidence
FROM ({EDGES}) LEFT JOIN ({NODES}) a ON a.id = source_id LEFT JOIN ({NODES}) b ON b.id = target_id""")
def relations_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).withColumn("confidence", F.lit(None).cast("double"))
    return S.named_edges(e, nodes(spark, sf_dir))


_EMB_EDGES = "SELECT vec_id AS source_id, vec_id + 1 AS target_id, 'NEXT' AS relation_type FROM embeddings"
_ANALYSIS = f"""q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7),
h AS (SELECT vec_id AS id, greatest(0.0, least(1.0, round({DOT.format(a='embedding', b='e')}, 9))) AS score FROM embeddings, q), t AS (SELECT * FROM h WHERE score >= 0.1 ORDER BY score DESC, id LIMIT 10),
l AS (SELECT source_id AS id, 'v' || source_id || ' NEXT v' || target_id AS line, target_id FROM ({_EMB_EDGES}) WHERE target_id IN (SELECT vec_id FROM embeddings)),
r AS (SELECT id, line FROM l UNION SELECT target_id, line FROM l),
a AS (SELECT t.id, score, 'v' || t.id || ' - label ' || label AS line, coalesce((SELECT list(r.line ORDER BY r.line) FROM r WHERE r.id = t.id), []) AS relations FROM t JOIN embeddings ON vec_id = t.id)"""


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("type"))
    hits = S.search_vectors(e, _query(spark, sf_dir), least=0.1, limit=10).select("id", "score")
    ents = e.select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("label "), "type").alias("description"))
    rel = e.select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"), F.lit("NEXT").alias("relation_type"), F.lit(1.0).alias("confidence"))
    return S.context_analysis(hits, ents, rel)


@query(f"WITH {_ANALYSIS} SELECT id, round(score, 3) AS score, line, array_to_string(relations, '|') AS relations FROM a")
def context_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).withColumn("relations", F.array_join("relations", "|"))


@query(f"""WITH {_ANALYSIS} SELECT string_agg(line || CASE WHEN len(relations) > 0 THEN chr(10) || array_to_string(relations, chr(10)) ELSE chr(10) END, chr(10) ORDER BY round(score, 3) DESC, id) AS prompt,
count(*) AS entities, CAST(sum(len(relations)) AS BIGINT) AS relations FROM a""")
def context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.context_prompt(_analysis(spark, sf_dir))


@query(f"SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM orders) AS chunks, (SELECT count(*) FROM ({EDGES})) AS relations")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.status(table(spark, sf_dir, "part"), table(spark, sf_dir, "orders"), edges(spark, sf_dir))


@query("SELECT n_name AS name, n_nationkey AS created_at FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 5)")
def backup_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.backups_to_drop(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("created_at")))


@query("""SELECT concat_ws('--', 's' || l_suppkey, 'SUPPLIES', 'p' || l_partkey) AS id, CAST(CASE WHEN min(l_discount) = 0 THEN 1.0 ELSE min(l_discount) END AS DOUBLE) AS confidence
FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY l_suppkey, l_partkey""")
def edge_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_discount").alias("confidence"))
    new = new.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_id"), F.lit("SUPPLIES").alias("relation_type"), "confidence")
    return S.create_edges(new, nodes(spark, sf_dir)).select("id", "confidence")
