"""Vector search: exact top-k by inner product, for one query or for a table of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.vectors import dot, rounded, rounded_np, similarity
from docloom.operators.providers import Embedder

PLACES = 9


def top_k(vectors: DataFrame, query: list[float], k: int, least: float | None = None, id_col: str = "id", vector: str = "embedding", clamp: bool = False) -> DataFrame:
    """The ``k`` rows of greatest product with one query vector, ties to the smaller id; a threshold is applied after."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = rounded((similarity if clamp else dot)(F.col(vector), q), PLACES)
    best = vectors.withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)
    return best if least is None else best.where(F.col("score") >= least)


def top_k_join(queries: DataFrame, vectors: DataFrame, k: int, least: float, query_rows: int = 8192, vector_rows: int = 16_384) -> DataFrame:
    """For each query (query_id, q) the ``k`` best rows of ``vectors`` (id, embedding) with at least ``least``.

    Blocks of queries meet blocks of vectors in a grid, one matrix product each, and give at most ``k`` rows per query; all
    of the grid is one job, and nothing but two counts comes to the driver.
    """
    import numpy as np
    import pyarrow as pa

    across, down = max(1, -(-queries.count() // query_rows)), max(1, -(-vectors.count() // vector_rows))
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    left = queries.select("query_id", double("q").alias("q"), place("query_id", across).alias("a"), every(down).alias("b"))
    right = vectors.select("id", double("embedding").alias("v"), every(across).alias("a"), place("id", down).alias("b"))

    def matrix(col: pa.ChunkedArray) -> np.ndarray:
        flat = col.combine_chunks()
        return flat.flatten().to_numpy().reshape(len(flat), -1)

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if q.num_rows and v.num_rows:
            ids, vid, mat, x = q["query_id"].to_pylist(), v["id"].to_numpy(), matrix(q["q"]), matrix(v["v"])
            for a in range(0, len(ids), 256):
                s = rounded_np(mat[a : a + 256] @ x.T, PLACES)
                for r in range(len(s)):
                    hit = np.flatnonzero(s[r] >= least)
                    if len(hit) > k:  # those as good as the k-th, which may be more than k
                        hit = hit[s[r, hit] >= np.partition(s[r, hit], -k)[-k]]
                    best = hit[np.lexsort((vid[hit], -s[r, hit]))][:k]
                    out += zip([ids[a + r]] * len(best), vid[best].tolist(), s[r, best].tolist())
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    out = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_match(candidates: DataFrame, by: str, score: Column, value: str, least: float = 0.6) -> DataFrame:
    """Per group the candidate of greatest score, if that reaches ``least``; ties to the smaller value."""
    s = candidates.withColumn("score", score)
    best = s.groupBy(by).agg(F.max_by(value, F.struct("score", -F.col(value))).alias(value), F.max("score").alias("score"))
    return best.where(F.col("score") >= least)


def first_jump(scores: DataFrame, by: str, order: str, score: str = "score", rise: float = 0.3, least: float = 0.5) -> DataFrame:
    """Per group the first place where the score rises by more than ``rise`` to more than ``least``."""
    w = Window.partitionBy(by).orderBy(order)
    up = scores.withColumn("before", F.lag(score).over(w)).where((rounded(F.col(score) - F.col("before"), PLACES) > rise) & (F.col(score) > least))
    return up.groupBy(by).agg(F.min(order).alias(order))


def embed_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct keys (sha256 of the trimmed text) that the cache lacks for the model."""
    return keyed(texts).dropDuplicates(["text_hash"]).join(cache.where(F.col("model") == model), "text_hash", "left_anti")


def keyed(texts: DataFrame) -> DataFrame:
    from docloom.functions.text import trim_u

    return texts.withColumn("text_hash", F.sha2(trim_u(F.col("text")), 256))


def embed_with_cache(texts: DataFrame, cache: DataFrame, embedder: Embedder, cached_at: Column, keep_key: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts with embeddings, rows to append to the cache).  Only distinct misses are embedded; append before use.

    ``keep_key`` keeps the column text_hash, so that who needs the keys needn't make them again and the texts can stay
    behind."""
    from docloom.functions.text import preview

    misses = embed_misses(texts, cache, embedder.model).select(F.lit(embedder.model).alias("model"), "text_hash", embedder.embed(F.col("text")).alias("embedding"), preview(F.col("text")).alias("text_preview"), cached_at.alias("cached_at"))
    known = cache.where(F.col("model") == embedder.model).select("text_hash", "embedding").unionByName(misses.select("text_hash", "embedding"))
    out = keyed(texts).join(known, "text_hash", "left")
    return out if keep_key else out.drop("text_hash"), misses


def cache_stats(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits, misses and hit rate of a table of looked-up keys against the cache."""
    marked = lookups.join(cache.select("text_hash", F.lit(1).alias("hit")).distinct(), "text_hash", "left")
    hits = F.count_if(F.col("hit").isNotNull())
    return marked.agg(hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("misses"), F.round(hits / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("hit_rate"))


def title_match(titles: DataFrame, windows: DataFrame, least: float = 0.6) -> DataFrame:
    """Whether a title is like the best word window of its page: titles (doc_id, page, title, q), windows (doc_id, page, v).

    Null where the page has no window.
    """
    both = titles.join(windows, ["doc_id", "page"], "left")
    return both.groupBy("doc_id", "page", "title").agg((F.max(F.when(F.col("v").isNotNull(), rounded(similarity(F.col("q"), F.col("v")), PLACES))) >= least).alias("matches"))


def cache_put(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache with new rows (model, text_hash, embedding, cached_at); of one key the latest is kept."""
    from docloom.operators.store import upsert

    key = lambda df: df.withColumn("__key", F.concat_ws("\u0001", "model", "text_hash"))
    return upsert(key(cache), key(new), "__key", "cached_at").drop("__key")


def cache_clear(cache: DataFrame, model: str | None = None) -> DataFrame:
    """The cache without the rows of one model, or without any."""
    return cache.where(F.col("model") != model) if model is not None else cache.limit(0)


def similar_chunks(chunks: DataFrame, query: list[float], least: float = 0.6, most: int = 20) -> DataFrame:
    """The chunks (id, embedding) most like a query vector, at least ``least``."""
    return top_k(chunks, query, most, least, clamp=True)
