"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import dot, rounded, similarity
from docloom.operators import search as V
from docloom.operators.providers import LetterEmbedder
from docloom.operators.store import search_vectors
from docloom.plans.catalog import query, table, trim_sql

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_Q = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)"
_S = f"s AS (SELECT vec_id AS id, label, round({DOT.format(a='embedding', b='e')}, 9) AS score FROM embeddings, q)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("type"), "embedding")


def _query(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(_vectors(spark, sf_dir).where("id = 7").first()["embedding"])


@query(f"WITH {_Q}, {_S} SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20")
def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 20).select("id", "score")


@query(f"WITH {_Q}, {_S} SELECT * FROM (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 200) WHERE score >= 0.1")
def vec_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 200, least=0.1).select("id", "score")


@query(f"WITH {_Q}, {_S} SELECT id, greatest(0.0, least(1.0, score)) AS score FROM s WHERE label = 3 AND score >= 0.1 ORDER BY score DESC, id LIMIT 10")
def vec_search_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_vectors(_vectors(spark, sf_dir), _query(spark, sf_dir), kind="3", least=0.1, limit=10).select("id", "score")


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, round({DOT.format(a='q.embedding', b='c.embedding')}, 9) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s WHERE score >= 0.2)
SELECT query_id, id, rank FROM r WHERE rank <= 8""")
def vec_context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest with at least 0.2, for a stated set of query vectors."""
    v = _vectors(spark, sf_dir)
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return V.top_k_join(q, v, 8, 0.2).select("query_id", "id", "rank")


@query(f"""WITH c AS (SELECT vec_id, label, avg(1.0) FROM embeddings GROUP BY ALL), {_Q},
s AS (SELECT vec_id, label, greatest(0.0, least(1.0, round({DOT.format(a='embedding', b='e')}, 9))) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS n FROM s)
SELECT label, vec_id, score FROM r WHERE n = 1 AND score >= 0.2""")
def vec_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _query(spark, sf_dir)))
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    return V.best_match(e, "label", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rounded(dot(F.col("embedding"), q)))), "vec_id", 0.2)


@query(f"""WITH {_Q}, s AS (SELECT vec_id, label, greatest(0.0, least(1.0, round({DOT.format(a='embedding', b='e')}, 9))) AS score FROM embeddings, q),
l AS (SELECT *, lag(score) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM s)
SELECT label, min(vec_id) AS vec_id FROM l WHERE round(score - b, 9) > 0.1 AND score > 0.1 GROUP BY label""")
def vec_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _query(spark, sf_dir)))
    s = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), rounded(dot(F.col("embedding"), q)))).alias("score"))
    return V.first_jump(s, "label", "vec_id", rise=0.1, least=0.1)


@query(f"""WITH p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, CASE WHEN b IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, round({DOT.format(a='a', b='b')}, 9))) END AS similarity FROM p""")
def vec_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return v.join(nxt, "vec_id", "left").select("vec_id", rounded(similarity(F.col("embedding"), F.col("b"))).alias("similarity"))


@query(f"""WITH k AS (SELECT DISTINCT sha256({trim_sql('text')}) AS text_hash FROM documents)
SELECT text_hash FROM k WHERE text_hash NOT IN (SELECT sha256({trim_sql('text')}) FROM documents WHERE lang = 'en')""")
def embed_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cache = V.keyed(d.where("lang = 'en'").select("text")).select("text_hash", F.lit("letters-26").alias("model")).distinct()
    return V.embed_misses(d.select("text"), cache, "letters-26").select("text_hash")


@query(f"""WITH k AS (SELECT sha256({trim_sql('text')}) AS h, lang FROM documents),
t AS (SELECT count(*) FILTER (h IN (SELECT h FROM k WHERE lang = 'en')) AS hits, count(*) AS n FROM k)
SELECT hits, n - hits AS misses, round(hits / greatest(1, n), 6) AS hit_rate FROM t""")
def embed_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.keyed(table(spark, sf_dir, "documents").select("text", "lang"))
    return V.cache_stats(d.select("text_hash"), d.where("lang = 'en'").select("text_hash"))


@query("""WITH c AS (SELECT doc_id, text AS s FROM documents), k AS (SELECT doc_id, list_transform(range(26), lambda k: CAST(length(s) - length(replace(lower(s), chr(CAST(97 + k AS INT)), '')) AS DOUBLE)) AS c FROM c),
n AS (SELECT doc_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM k)
SELECT doc_id, list_transform(c, lambda x: CASE WHEN norm > 0 THEN round(x / norm, 9) ELSE 0.0 END) AS embedding FROM n""")
def embed_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", LetterEmbedder().embed(F.col("text")).alias("embedding"))


@query(f"""WITH t AS (SELECT vec_id AS doc_id, embedding AS q FROM embeddings), w AS (SELECT vec_id - 1 AS doc_id, embedding AS v FROM embeddings UNION ALL SELECT vec_id - 2, embedding FROM embeddings)
SELECT t.doc_id, max(CASE WHEN v IS NOT NULL THEN greatest(0.0, least(1.0, round({DOT.format(a='q', b='v')}, 9))) END) >= 0.1 AS matches FROM t LEFT JOIN w ON w.doc_id = t.doc_id GROUP BY t.doc_id""")
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a title against the two after it as windows of its page; the last one's page has none."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    titles = e.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("page"), F.lit("t").alias("title"), F.col("embedding").alias("q"))
    w = lambda k: e.select((F.col("vec_id") - k).alias("doc_id"), F.lit(0).alias("page"), F.col("embedding").alias("v"))
    return V.title_match(titles, w(1).union(w(2)), 0.1).select("doc_id", "matches")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def vec_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["Window"]
