"""Queries on what the service and the pipelines around the store answer: lookups, lists, exports, extraction chains, caches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators import extraction as X
from docloom.operators import graph as G
from docloom.operators import pages as P
from docloom.operators import search as V
from docloom.operators import store as S
from docloom.operators import structure as R
from docloom.operators import toc
from docloom.operators.domains import DOMAINS, THRESHOLDS, classify, extend_types, extraction_prompt, meta_instructions, percentile_of
from docloom.operators.providers import FALLBACK, LIMITS, LetterEmbedder, RuleClassifier, context_limit, output_limit
from docloom.plans.catalog import SQL, query, table, trim_sql
from docloom.plans.chunk_queries import _CHUNK_LINE, chunk_line
from docloom.plans.entity_queries import _DOMAIN, _MENTIONS
from docloom.plans.graph_queries import EDGES, NODES, PARTS, edges, nodes, parts, raw_edges
from docloom.plans.layout_queries import _END, _START, CONV, TOC_LINES, conv_pages, lines
from docloom.plans.stream_queries import _shared
from docloom.plans.vector_queries import DOT, _query, _vectors

Q7 = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)"


# --- lookups, lists, answers -------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_name AS name, p_type AS type, NULL AS description, p_size / 50.0 AS confidence, p_brand AS aliases, 'c' || p_size AS source_chunks FROM part")
def entity_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parts(spark, sf_dir).withColumn("source_chunk_ids", F.array(F.concat(F.lit("c"), F.col("updated_at").cast("string"))))
    return S.response(e).withColumns({"aliases": F.array_join("aliases", "|"), "source_chunks": F.array_join("source_chunks", "|")})


@query(f"SELECT id, name, type FROM ({PARTS}) WHERE id = 7")
def entity_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity 7, and none for an id that nothing has."""
    p = parts(spark, sf_dir).select("id", "name", "type")
    return S.by_id(p, 7).union(S.by_id(p, -1))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def chunk_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return S.by_id(o, o.agg(F.min("id")).first()[0])


_ID = "concat_ws('--', source_id, relation_type, target_id)"


@query(f"SELECT source_id, target_id, relation_type, {_ID} AS id FROM ({EDGES}) WHERE {_ID} = (SELECT min({_ID}) FROM ({EDGES}) WHERE source_id = 's3')")
def edge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    wanted = e.where("source_id = 's3'").agg(F.min(G.edge_id())).first()[0] or ""
    return G.edge_by_id(e, wanted)


@query(f"""WITH f AS (SELECT * FROM ({EDGES}) WHERE source_id = 's3' OR target_id = 's3')
SELECT *, (SELECT count(*) FROM f) AS total_found, CAST(greatest(0, least(25, (SELECT count(*) FROM f) - 10)) AS BIGINT) AS returned FROM f ORDER BY source_id, target_id LIMIT 25 OFFSET 10""")
def relations_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edge_list(edges(spark, sf_dir), "s3", offset=10, limit=25)


@query(f"""SELECT 'type' AS kind, entity_type AS name, count(*) AS n FROM ({NODES}) WHERE node_type = 'entity' GROUP BY entity_type
UNION ALL SELECT 'relation', relation_type, count(*) FROM ({EDGES}) GROUP BY relation_type
UNION ALL SELECT 'total', 'entities', count(*) FROM ({NODES}) WHERE node_type = 'entity' UNION ALL SELECT 'total', 'relations', count(*) FROM ({EDGES})""")
def analysis_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nodes(spark, sf_dir).where("node_type = 'entity'").withColumnRenamed("entity_type", "type")
    return S.analysis_stats(e, edges(spark, sf_dir))


_RELATED = f"""e AS ({EDGES}), n AS (SELECT id, name, entity_type AS type FROM ({NODES}) WHERE node_type = 'entity'),
k AS (SELECT source_id AS a, target_id AS b FROM e WHERE target_id IN (SELECT id FROM n) UNION SELECT target_id, source_id FROM e WHERE source_id IN (SELECT id FROM n)),
h1 AS (SELECT DISTINCT b AS id FROM k WHERE a = 's3'), h2 AS (SELECT DISTINCT k.b AS id FROM h1 JOIN k ON k.a = h1.id), r AS (SELECT id FROM (FROM h1 UNION FROM h2) WHERE id <> 's3')"""


@query(f"""WITH {_RELATED},
ow AS (SELECT source_id, target_id, relation_type, 'outgoing' AS direction FROM e WHERE source_id = 's3' UNION ALL SELECT source_id, target_id, relation_type, 'incoming' FROM e WHERE target_id = 's3'),
a AS (SELECT 'edge' AS part, CAST(row_number() OVER (ORDER BY source_id, target_id, relation_type, direction) AS INTEGER) AS place, {_ID} AS id, direction AS text FROM ow QUALIFY place <= 20),
b AS (SELECT 'related' AS part, CAST(row_number() OVER (ORDER BY id) AS INTEGER) AS place, id, name || ' ' || type AS text FROM n WHERE id IN (FROM r) QUALIFY place <= 10)
SELECT 'entity' AS part, 1 AS place, id, name || ' ' || type AS text FROM n WHERE id = 's3' UNION ALL FROM a UNION ALL FROM b
UNION ALL SELECT 'metadata', 1, 's3', (SELECT count(*) FROM a) || ' ' || (SELECT count(*) FROM b) WHERE EXISTS (FROM n WHERE id = 's3')""")
def entity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nodes(spark, sf_dir).where("node_type = 'entity'").select("id", "name", F.col("entity_type").alias("type"))
    return S.details(e, edges(spark, sf_dir), "s3")


@query(f"""WITH {_MENTIONS}, b AS (SELECT type AS name, count(*) AS before FROM ok WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY type), a AS (SELECT type AS name, count(*) AS after FROM ok GROUP BY type)
SELECT name, coalesce(before, 0) AS before, after, after - coalesce(before, 0) AS added FROM a LEFT JOIN b USING (name)""")
def process_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by type before and after all but the English documents have been processed."""
    chunks = chunk_line(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    found = X.second_gate(X.validate(X.mentions(chunks), list(DOMAINS["literary"].types))).select("type", "lang").persist()
    count = lambda df: df.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return S.growth(count(found.where("lang = 'en'")), count(found))


@query("""SELECT sha256(p_name || chr(1) || p_type) AS id, p_name AS name, p_type AS type, CAST(CASE WHEN p_size % 7 = 0 THEN 1.0 ELSE least(1.0, p_size / 40.0) END AS DOUBLE) AS confidence FROM part""")
def entity_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("updated_at")
    c = F.when(size % 7 == 0, F.when(size % 2 == 0, F.lit(0.0))).otherwise(size / 40.0)
    return S.create_entities(parts(spark, sf_dir).select("name", "type", c.alias("confidence"))).select("id", "name", "type", "confidence")


# --- chunks, nodes, edges ------------------------------------------------------------------------


_REG = f"""cl AS ({_CHUNK_LINE}), rg AS (SELECT doc_id, CASE WHEN chunk_id % 2 = 0 THEN doc_id || '-' || chunk_id ELSE sha256('d' || doc_id || chr(1) || start || chr(1) || "end") END AS id, chunk_id FROM cl)"""


def _registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string"))
    c = chunk_line(spark, sf_dir).withColumns({"id": F.when(F.col("chunk_id") % 2 == 0, key), "document_source": F.concat(F.lit("d"), F.col("doc_id").cast("string"))})
    return S.register_chunks(c)


@query(f"WITH {_REG} SELECT doc_id, chunk_id, id, false AS processed FROM rg")
def chunk_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registered(spark, sf_dir).select("doc_id", "chunk_id", "id", "processed")


@query(f"WITH {_REG} SELECT id AS source_id, unnest(['e' || doc_id, 'lang' || chunk_id]) AS target_id, 'CONTAINS' AS relation_type FROM rg WHERE chunk_id % 3 = 0")
def chunk_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _registered(spark, sf_dir)
    a, b = F.concat(F.lit("e"), F.col("doc_id").cast("string")), F.concat(F.lit("lang"), F.col("chunk_id").cast("string"))
    found = r.where("chunk_id % 3 = 0").select("id", F.array(a, b, a).alias("entity_ids"))
    return S.persist_chunks(r, found)[1].select("source_id", "target_id", "relation_type")


@query(f"SELECT id, CASE WHEN entity_type = 'ECONOMY' THEN name || '*' ELSE name END AS name FROM ({NODES}) WHERE node_type = 'entity'")
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where("node_type = 'entity'").withColumn("updated_at", F.lit(1))
    new = n.where("entity_type = 'ECONOMY'").withColumns({"name": F.concat("name", F.lit("*")), "updated_at": F.lit(2)})
    return G.upsert_nodes(n, new.union(new.withColumns({"name": F.lit("old"), "updated_at": F.lit(0)}))).select("id", "name")


@query("SELECT 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id, 'CONTAINS' AS relation_type, CAST(max(l_linenumber) AS INTEGER) AS created_at FROM lineitem GROUP BY l_orderkey, l_partkey")
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    e = table(spark, sf_dir, "lineitem").select(key("o", "l_orderkey").alias("source_id"), key("p", "l_partkey").alias("target_id"), F.lit("CONTAINS").alias("relation_type"), F.col("l_linenumber").cast("int").alias("created_at"), F.lit(1.0).alias("confidence"))
    return G.upsert_edges(e.where("created_at % 2 = 0"), e.where("created_at % 2 = 1")).select("source_id", "target_id", "relation_type", "created_at")


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN 'first|' || n_name || CASE WHEN n_regionkey = 0 THEN '|' || n_name || '!' ELSE '' END ELSE 'first' END AS descriptions FROM nation""")
def graph_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey", F.array(F.lit("first")).alias("descriptions"))
    new = n.where("n_regionkey < 2").select("id", F.col("n_name").alias("text")).union(n.where("n_regionkey = 0").select("id", F.concat("n_name", F.lit("!"))))
    return G.with_description(n, new).select("id", F.array_join("descriptions", "|").alias("descriptions"))


@query(f"""WITH n AS ({NODES}), e AS ({EDGES}) SELECT 'node' AS part, id, '{{"id":"' || id || '","node_type":"' || node_type || '"' || coalesce(',"entity_type":"' || entity_type || '"', '') || coalesce(',"name":"' || name || '"', '') || '}}' AS json FROM n
UNION ALL SELECT 'edge', {_ID}, '{{"source_id":"' || source_id || '","target_id":"' || target_id || '","relation_type":"' || relation_type || '"}}' FROM e
UNION ALL SELECT 'counts', '', '{{"nodes":' || (SELECT count(*) FROM n) || ',"entities":' || (SELECT count(*) FROM n WHERE node_type = 'entity') || ',"chunks":' || (SELECT count(*) FROM n WHERE node_type = 'chunk') || ',"edges":' || (SELECT count(*) FROM e) || '}}'""")
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.export(nodes(spark, sf_dir), edges(spark, sf_dir))


@query(f"""WITH n AS ({NODES}), k AS (SELECT * FROM n WHERE node_type <> 'entity' OR entity_type IN ('ECONOMY', 'SUPPLIER')), e AS (SELECT * FROM ({EDGES}) WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k))
SELECT least(900, (SELECT count(*) FROM k)) AS nodes, (SELECT count(*) FROM k) > 900 AS nodes_truncated, least(900, (SELECT count(*) FROM e)) AS edges, (SELECT count(*) FROM e) > 900 AS edges_truncated,
(SELECT string_agg(DISTINCT entity_type, '|' ORDER BY entity_type) FROM n WHERE node_type = 'entity') AS types""")
def graph_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.view(nodes(spark, sf_dir), raw_edges(spark, sf_dir), ["ECONOMY", "SUPPLIER"])


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("entity").alias("node_type"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note"))
    e = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source_id"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("target_id"), F.lit("IN").alias("relation_type"), F.lit(1.5).alias("weight"))
    return n, e


_LINKS = "SELECT 'n' || n_nationkey || '--IN--n' || n_regionkey AS id, '{\"source\":\"n' || n_nationkey || '\",\"target\":\"n' || n_regionkey || '\",\"relation_type\":\"IN\",\"weight\":1.5}' AS json FROM nation"
_NODE_LINES = "SELECT 'n' || n_nationkey AS id, '{\"id\":\"n' || n_nationkey || '\",\"node_type\":\"entity\",\"name\":\"' || n_name || '\"}' AS json FROM nation"


@query(f"""SELECT 0 AS ord, '' AS id, '{{"directed":true,"multigraph":false,"graph":{{}},"nodes":[' AS line UNION ALL SELECT 2, '', '],"links":[' UNION ALL SELECT 4, '', ']}}'
UNION ALL SELECT 1, id, json || CASE WHEN id < (SELECT max(id) FROM ({_NODE_LINES})) THEN ',' ELSE '' END FROM ({_NODE_LINES})
UNION ALL SELECT 3, id, json || CASE WHEN id < (SELECT max(id) FROM ({_LINKS})) THEN ',' ELSE '' END FROM ({_LINKS})""")
def graph_node_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.node_link_lines(*_nations(spark, sf_dir))


@query("SELECT 'n' || n_nationkey AS source_id, 'n' || n_regionkey AS target_id, 'IN' AS relation_type, 1.5 AS weight, n_name AS name FROM nation")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as a node-link file and read back, each edge with its source's name."""
    n, e = _nations(spark, sf_dir)
    at = f"{_shared(spark)}/graph-{uuid.uuid4().hex}"
    G.node_link_lines(n, e).coalesce(1).sortWithinPartitions("ord", "id").select("line").write.text(f"{at}/graph.json")
    got, links = G.read_graph(spark, at, "id string, node_type string, name string", "relation_type string, weight double")
    return links.join(got.select(F.col("id").alias("source_id"), "name"), "source_id")


@query("SELECT 'n' || n_nationkey AS id, n_name AS name, 'n' || n_regionkey AS target_id, 1.5 AS weight FROM nation")
def graph_graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written as GraphML and read back, which is done where there is no node-link file."""
    from docloom.sources.sinks import graphml

    n, e = _nations(spark, sf_dir)
    at = f"{_shared(spark)}/graph-{uuid.uuid4().hex}"
    graphml(n, e).coalesce(1).sortWithinPartitions("ord", "line").select("line").write.text(f"{at}/graph.graphml")
    got, links = G.read_graph(spark, at, "id string, node_type string, name string", "relation_type string, weight double")
    return got.join(links, got["id"] == links["source_id"]).select("id", "name", "target_id", "weight")


@query("""WITH n AS (SELECT count(*) AS n FROM nation) SELECT 'metadata' AS section, '' AS key, '{"version":"2.0","nodes":' || 2 * n || ',"links":' || n || '}' AS json FROM n
UNION ALL SELECT 'entities', 'n' || n_nationkey, '{"id":"n' || n_nationkey || '","type":"NATION"}' FROM nation UNION ALL SELECT 'chunks', 'c' || n_nationkey, '{"id":"c' || n_nationkey || '"}' FROM nation
UNION ALL SELECT 'graph', 'n' || n_nationkey || '--IN--n' || n_regionkey, '{"source_id":"n' || n_nationkey || '","target_id":"n' || n_regionkey || '","relation_type":"IN"}' FROM nation
UNION ALL SELECT 'statistics', 'type/NATION', '{"kind":"type","name":"NATION","n":' || n || '}' FROM n UNION ALL SELECT 'statistics', 'relation/IN', '{"kind":"relation","name":"IN","n":' || n || '}' FROM n
UNION ALL SELECT 'statistics', 'total/entities', '{"kind":"total","name":"entities","n":' || n || '}' FROM n UNION ALL SELECT 'statistics', 'total/relations', '{"kind":"total","name":"relations","n":' || n || '}' FROM n""")
def knowledge_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _nations(spark, sf_dir)
    return S.knowledge_export(n.select("id", F.lit("NATION").alias("type")), n.select(F.regexp_replace("id", "^n", "c").alias("id")), e.drop("weight"))


@query(f"SELECT count(*) AS entities, 0 AS missing, '2.0' AS version FROM ({PARTS})")
def store_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved store opened as a whole: a table that was never saved is empty, and so is the metadata of a new store."""
    at = f"{_shared(spark)}/store-{uuid.uuid4().hex}"
    s = S.Store(spark, at)
    s.save("entities", parts(spark, sf_dir))
    s.save("metadata", spark.createDataFrame([("2.0",)], "storage_version string"))
    t = s.open({"entities": "id long", "chunks": "id string"})
    return t["entities"].agg(F.count(F.lit(1)).alias("entities")).join(t["chunks"].agg(F.count(F.lit(1)).cast("int").alias("missing"))).join(s.metadata().select(F.col("storage_version").alias("version")))


# --- extraction ----------------------------------------------------------------------------------


_OWN = " ".join(f"WHEN '{d.name}' THEN type IN ({', '.join(repr(t) for t in d.types)})" for d in DOMAINS.values())


@query(f"WITH {_MENTIONS}, {_DOMAIN} SELECT domain, doc_id, chunk_id, name, type, confidence FROM ok JOIN dm USING (doc_id) WHERE CASE domain {_OWN} END")
def entity_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", RuleClassifier().domains(F.col("lang"), F.col("source")).alias("domains"))
    chunks = chunk_line(spark, sf_dir).join(docs, "doc_id")
    return X.by_domain(chunks, F.col("domains")).select("domain", "doc_id", "chunk_id", "name", "type", "confidence")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a classifier and a meta-analysis might reply for each event."""
    k = F.col("event_id") % 6
    said = F.when(k == 0, F.lit('{"domains": ["Literary", "nonsense", " owu "]}')).when(k == 1, F.lit('["financial", "financial"]')).when(k == 2, F.lit("not json")).when(k == 3, F.lit('{"domains": []}')).when(k == 4, F.lit('["unheard"]'))
    told = F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit(" Look for "), "event_type", F.lit(" "))).when(k == 2, F.lit(None).cast("string")).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", said.alias("said"), told.alias("told"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'literary|owu' WHEN 1 THEN 'financial' ELSE 'simple' END AS domains FROM events")
def domain_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("event_id", F.array_join(classify(F.col("said")), "|").alias("domains"))


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Look for ' || event_type WHEN 2 THEN NULL ELSE trim(props) END AS instructions FROM events")
def meta_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("event_id", meta_instructions(F.col("told")).alias("instructions"))


_BASE = DOMAINS["simple"].extraction.split("{text}")[0].replace("{types}", ", ".join(DOMAINS["simple"].types)).replace("\n", "' || chr(10) || '")


@query(f"""SELECT event_id, coalesce(CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Look for ' || event_type WHEN 2 THEN NULL ELSE trim(props) END || chr(10), '{_BASE}')
|| CASE WHEN event_id % 2 = 0 THEN chr(10) || 'Known already:' || chr(10) || 'a' || chr(10) || event_type || chr(10) ELSE '' END || event_type AS prompt FROM events""")
def prompt_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"), F.col("event_type")))
    return _replies(spark, sf_dir).select("event_id", extraction_prompt("simple", F.col("event_type"), F.col("told"), known).alias("prompt"))


@query(f"""WITH s AS (SELECT q.vec_id AS chunk_id, c.vec_id AS id, c.label, round({DOT.format(a='q.embedding', b='c.embedding')}, 9) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.label = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.1)
SELECT chunk_id, string_agg('v' || id || ' (' || label || ') = x' || id || ', y, z', chr(10) ORDER BY rank) AS known FROM r WHERE rank <= 8 GROUP BY chunk_id""")
def entity_context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a prompt would have about the eight entities nearest to each of a stated set of chunks."""
    v = _vectors(spark, sf_dir)
    hits = V.top_k_join(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), v.where("type = '3'"), 8, 0.1)
    e = v.select("id", "type", F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), F.array(F.concat(F.lit("x"), F.col("id").cast("string")), F.lit("y"), F.lit("z"), F.lit("too many")).alias("aliases"))
    known = X.known_lines(hits.withColumnRenamed("query_id", "chunk_id").join(e, "id"), "chunk_id")
    return known.select("chunk_id", F.array_join(F.transform("known", lambda x: F.regexp_replace(x, " SIMILAR_CONTEXT .*", "")), "\n").alias("known"))


@query(f"""WITH {_MENTIONS} SELECT doc_id, chunk_id, name, type, 'c' || doc_id || '-' || chunk_id AS source_chunk_id, 'documents/' || doc_id AS document_source, '2024-01-01 00:00:00' AS created_at FROM ok""")
def entity_store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunk_line(spark, sf_dir).withColumn("id", F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), F.col("chunk_id").cast("string")))
    found = X.second_gate(X.validate(X.mentions(c.drop("id")), list(DOMAINS["literary"].types)))
    rows = X.stored_rows(found, c, ["doc_id", "chunk_id"], F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return rows.select("doc_id", "chunk_id", "name", "type", "source_chunk_id", "document_source", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("""SELECT l_orderkey AS chunk, 's' || l_suppkey AS source_id, 'p' || l_partkey AS target_id, 'SUPPLIES' AS relation_type, CAST(l_linenumber AS INTEGER) AS line
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber <= 2""")
def relations_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations by name between what stands in one chunk; names are compared whatever their case."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    key = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    chunk = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("chunk")
    li = li.select("l_orderkey", "l_linenumber", chunk, key("s", "l_suppkey").alias("s"), key("p", "l_partkey").alias("p"))
    have = nodes(spark, sf_dir).select("id")
    e = li.select("chunk", F.col("s").alias("id")).union(li.select("chunk", "p")).distinct().join(have, "id", "left_semi").withColumn("name", F.concat(F.lit("name of "), "id"))
    said = li.select("chunk", F.concat(F.lit(" NAME of "), "s").alias("source"), F.concat(F.lit("name OF "), "p", F.lit(" ")).alias("target"), F.lit("supplies").alias("type"), F.lit("").alias("evidence"))
    lost = li.select("chunk", F.lit("nobody").alias("source"), F.concat(F.lit("name of "), "p").alias("target"), F.lit("KNOWS").alias("type"), F.lit("").alias("evidence"))
    got = X.resolve_relations(said.union(lost), e, ["chunk"])
    return got.select(F.split("chunk", "/")[0].cast("long").alias("chunk"), "source_id", "target_id", "relation_type", F.split("chunk", "/")[1].cast("int").alias("line"))


@query("SELECT p_partkey AS id, 'ECONOMY|PROMO' || CASE WHEN p_type NOT IN ('ECONOMY', 'PROMO') THEN '|' || p_type ELSE '' END || '|' || upper(p_brand) AS types FROM part")
def type_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(extend_types(F.array(F.lit("economy"), F.lit("PROMO")), F.array("p_type", F.lit("Promo"), "p_brand")), "|").alias("types"))


# --- vectors and their cache ---------------------------------------------------------------------


@query(f"WITH {Q7} SELECT vec_id AS id, greatest(0.0, least(1.0, round({DOT.format(a='embedding', b='e')}, 9))) AS score FROM embeddings, q WHERE greatest(0.0, least(1.0, round({DOT.format(a='embedding', b='e')}, 9))) >= 0.2 ORDER BY score DESC, id LIMIT 20")
def chunk_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar_chunks(_vectors(spark, sf_dir), _query(spark, sf_dir), 0.2).select("id", "score")


@query("SELECT p_partkey AS id, p_name || ' ' || p_type AS name_text, p_name || ' ' || p_type || CASE WHEN p_size > 10 THEN ' size ' || p_size ELSE '' END || ' ' || p_brand AS context_text FROM part")
def entity_embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.when(F.col("p_size") > 10, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("description"), F.col("p_brand").alias("context"))
    return S.embedding_texts(e).select("id", "name_text", "context_text")


_HASH = f"sha256({trim_sql('text')})"


@query(f"SELECT doc_id, {_HASH} AS text_hash, true AS embedded, (SELECT count(DISTINCT {_HASH}) FROM documents) AS cached FROM documents")
def embed_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts embedded through a cache that knows the English ones; the misses written back, and the cache counted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = LetterEmbedder()
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    first = V.embed_with_cache(d.where("lang = 'en'").drop("lang"), spark.createDataFrame([], "model string, text_hash string, embedding array<double>, text_preview string, cached_at timestamp"), model, at)[1]
    out, new = V.embed_with_cache(d.drop("lang"), first, model, at, keep_key=True)
    cache = V.cache_put(first, new)
    return out.select("doc_id", "text_hash", F.col("embedding").isNotNull().alias("embedded")).join(F.broadcast(cache.agg(F.count(F.lit(1)).alias("cached"))))


@query("SELECT 'a' AS model, count(DISTINCT p_brand) AS n, max(p_size) AS latest FROM part")
def embed_cache_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of two models, put twice, without one of them."""
    p = table(spark, sf_dir, "part").select(F.lit("a").alias("model"), F.col("p_brand").alias("text_hash"), F.array(F.lit(1.0)).alias("embedding"), F.col("p_size").alias("cached_at"))
    latest = p.groupBy("model", "text_hash").agg(F.max("cached_at").alias("cached_at")).withColumn("embedding", F.array(F.lit(1.0)))
    old = latest.withColumn("cached_at", F.lit(0))
    c = V.cache_put(old.unionByName(old.withColumn("model", F.lit("b"))), latest)
    return V.cache_clear(c, "b").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max("cached_at").alias("latest"))


# --- chunking settings, pages, tables of contents --------------------------------------------------


@query("SELECT domain, CAST(percentile AS DOUBLE) AS percentile FROM (VALUES ('literary', 92.0), ('simple', 88.0), ('financial', 90.0), ('owu', 88.0), ('auto', 90.0), ('unheard', 90.0)) t(domain, percentile)")
def domain_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d, float(percentile_of([d]))) for d in ("literary", "simple", "financial", "owu", "auto", "unheard")], "domain string, percentile double")


_KNOWN = sorted(LIMITS)


@query(f"SELECT * FROM (VALUES {', '.join(f'({m!r}, {LIMITS[m][0]}, {LIMITS[m][1]}, {int((LIMITS[m][0] - 1500) * 0.75)})' for m in _KNOWN)}, ('unheard', {FALLBACK[0]}, {FALLBACK[1]}, {int((FALLBACK[0] - 1500) * 0.75)})) t(model, context, output, chunk)")
def model_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits by model and the chunk size that follows from them and the overhead of a prompt without domains."""
    return spark.createDataFrame([(m, context_limit(m), output_limit(m), C.chunk_size(m)) for m in [*_KNOWN, "unheard"]], "model string, context int, output int, chunk int")


@query("SELECT * FROM (VALUES ('', 1500), ('literary', 300 + CAST(floor(1.33 * 18) AS INTEGER)), ('simple', 300 + CAST(floor(1.33 * 18) AS INTEGER))) t(domain, overhead)")
def prompt_overheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a prompt needs besides its text: its words times 1.33, and 300."""
    words = lambda d: [DOMAINS[d]] if d else None
    return spark.createDataFrame([(d, C.prompt_overhead(words(d))) for d in ("", "literary", "simple")], "domain string, overhead int")


@query(SQL["chunk_section"])
def chunk_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the strategy that the first domain names."""
    return C.chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), ["owu", "literary"])


@query(f"""SELECT doc_id, chunk_id, 'documents/' || doc_id AS document_source, 'line' AS chunking_strategy, 'm' AS model_used, 1000 AS chunk_size_target, 0 AS overlap_size, CAST(length(text) AS INTEGER) AS text_length, 'simple|owu' AS domains FROM ({_CHUNK_LINE})""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.with_metadata(chunk_line(spark, sf_dir), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), "line", "m", 1000, 0, ["simple", "owu"])
    return rows.select("doc_id", "chunk_id", "document_source", "chunking_strategy", "model_used", "chunk_size_target", "overlap_size", "text_length", F.array_join("domains", "|").alias("domains"))


@query(f"""WITH c AS ({SQL['header_remove']}), {CONV}
SELECT pg.doc_id, CAST(sum(octet_length(encode(text)) - octet_length(encode(clean))) AS BIGINT) AS removed, count(*) FILTER (text <> clean) AS pages_cleaned,
round(CAST(sum(octet_length(encode(text)) - octet_length(encode(clean))) AS DOUBLE) / sum(octet_length(encode(text))), 6) AS efficiency FROM pg JOIN c USING (doc_id, page) GROUP BY pg.doc_id""".replace("WITH c AS (WITH RECURSIVE", "WITH RECURSIVE c AS (WITH RECURSIVE"))
def cleaning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conv_pages(spark, sf_dir)
    return P.cleaning_stats(P.without_furniture(p, P.furniture(p)))


@query(f"WITH {CONV} SELECT doc_id, count(*) AS pages, count(*) FILTER (status = 'error') AS failed FROM pg GROUP BY doc_id")
def pages_all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conv_pages(spark, sf_dir)
    good, bad = p.where("status = 'success'"), p.where("status <> 'success'").drop("text")
    every = P.all_results(good.where("page % 2 = 0"), good.where("page % 2 = 1"), bad)
    return every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "error").alias("failed"))


@query("SELECT event_id, event_id % 4 < 3 AS limited FROM events")
def rate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    error = F.when(k == 0, F.concat(F.lit("HTTP 429 for "), "event_type")).when(k == 1, F.lit("Too Many Requests")).when(k == 2, F.lit("rate_limit_exceeded")).otherwise(F.concat(F.lit("timeout of "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", P.is_rate_limit(error).alias("limited"))


@query(f"""WITH {TOC_LINES}, {_START}, {_END}, f AS (SELECT doc_id, arg_min(start_page, start_page * 1000 + start_y) AS start_page, arg_min(end_page, start_page * 1000 + start_y) AS end_page, arg_min(entry_count, start_page * 1000 + start_y) AS n FROM en GROUP BY doc_id)
SELECT d.doc_id, start_page, end_page, CAST(coalesce(n, 0) AS INTEGER) AS entries, CASE WHEN f.doc_id IS NOT NULL THEN 'patterns' END AS method, coalesce(n, 0) > 0 AS ready_for_splitting,
CASE WHEN f.doc_id IS NULL THEN 'no table of contents' WHEN n = 0 THEN 'no entries' END AS reason FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN f USING (doc_id)""")
def toc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return toc.final_records(docs, toc.detect(lines(spark, sf_dir, toc=True))).select("doc_id", "start_page", "end_page", "entries", "method", "ready_for_splitting", "reason")


@query(f"""WITH {TOC_LINES}, {_START}, {_END} SELECT CASE WHEN end_page - start_page <= 1 THEN 'certain' WHEN end_page - start_page <= 5 THEN 'uncertain' ELSE 'rejected' END AS category, end_method, count(*) AS n FROM en GROUP BY ALL""")
def toc_candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.sources.sinks import candidate_counts

    return candidate_counts(toc.detect(lines(spark, sf_dir, toc=True)))


_RANGES = "sx AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS section, CAST(turn - length(text) % 3 + 1 AS INTEGER) AS a, CAST(turn + length(role) % 3 AS INTEGER) AS b FROM conversations), sz AS (SELECT conv_id AS doc_id, count(*) AS pages FROM conversations GROUP BY conv_id)"


@query(f"WITH {_RANGES} SELECT doc_id, section, CAST(unnest(generate_series(a, b)) AS INTEGER) AS page, NULL AS reason FROM sx JOIN sz USING (doc_id) WHERE a <= b AND a >= 0 AND b < pages UNION ALL SELECT doc_id, section, NULL, CASE WHEN a > b THEN 'start after end' ELSE 'out of range' END FROM sx JOIN sz USING (doc_id) WHERE NOT (a <= b AND a >= 0 AND b < pages)")
def page_range_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("int")
    s = c.select(F.col("conv_id").alias("doc_id"), turn.alias("section"), (turn - F.length("text") % 3 + 1).alias("start_page"), (turn + F.length("role") % 3).alias("end_page"))
    good, bad = R.page_ranges(s, c.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("pages")))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.withColumn("page", F.lit(None).cast("int")))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' ELSE 'image/jpeg' END AS mime, CAST(octet_length(encode(url)) AS INTEGER) AS bytes FROM pages")
def image_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images by the first bytes of their base64 form, and the bytes that come back from it."""
    k = F.col("page_id") % 5
    head = F.when(k == 0, F.unhex(F.lit("89504E470D0A1A0A0000000D"))).when(k == 1, F.unhex(F.lit("FFD8FFE0"))).when(k == 2, F.encode(F.lit("GIF89a"), "UTF-8")).when(k == 3, F.encode(F.lit("RIFF0000WEBP"), "UTF-8")).otherwise(F.encode(F.lit("?"), "UTF-8"))
    b = F.base64(F.concat(head, F.encode("url", "UTF-8")))
    return table(spark, sf_dir, "pages").select("page_id", T.mime_of(b).alias("mime"), (F.octet_length(F.unbase64(b)) - F.octet_length(head)).alias("bytes"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("at"), F.date_format(ts, "yyyyMMdd_HHmmss").alias("stamp"))


@query("SELECT type, CAST(coalesce(NULL, 0.3) AS DOUBLE) AS threshold FROM (SELECT DISTINCT upper(event_type) AS type FROM events) WHERE type NOT IN (" + ", ".join(map(repr, THRESHOLDS)) + ")")
def default_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.operators.domains import threshold

    kinds = table(spark, sf_dir, "events").select(F.upper("event_type").alias("type")).distinct().where(~F.col("type").isin(*THRESHOLDS))
    return kinds.select("type", threshold(F.col("type")).cast("double").alias("threshold"))

