"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; documents in at least as many partitions as there are cores, since a file of a single row group would leave
    all work on its texts to one.  Tables with enough row groups, as any large one has, are read as they are."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table == "documents" and df.rdd.getNumPartitions() < cores else df


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(modulus: int, fold: int):
    """Whether a row is in the fold that isn't learned from; null for a null doc_id, which is in no fold."""
    from docloom.llm.common import crc_mod

    return (crc_mod("doc_id", modulus) == fold).alias("held_out")


# --- 1 ---------------------------------------------------------------------------------------


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``flagged`` is the decision against the threshold calibrated for the row's language."""
    from docloom.llm import toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), modulus=4, held_out=2)
    out = toxicity.scores(docs, model)
    return out.select("doc_id", held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "flagged")


# --- 2 ---------------------------------------------------------------------------------------


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.topk import quantise, top_products

    vectors = quantise(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_products(vectors, vectors.where("vec_id % 50 = 0"), k=5)


_OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


# --- 3 ---------------------------------------------------------------------------------------


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.ngram_join import similar_documents

    return similar_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), n=2, pct=60)


_OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM d WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN c x ON x.doc_id = o.a JOIN c y ON y.doc_id = o.b WHERE 100 * o.n >= 60 * (x.n + y.n - o.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce((SELECT n FROM c WHERE c.doc_id = d.doc_id), 0) AS n_shingles,
       (SELECT count(*) FROM l WHERE l.a = d.doc_id) AS n_similar, (SELECT min(b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM d"""


# --- 4 ---------------------------------------------------------------------------------------


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import pii

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.spans_of(docs, pii.fit(docs))


# --- 5 ---------------------------------------------------------------------------------------


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.substring import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


_OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS s FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 12], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS first FROM k GROUP BY h HAVING count(*) > 1),
r AS (SELECT DISTINCT k.doc_id, unnest(generate_series(s, s + 12)) AS i FROM k JOIN m USING (h) WHERE k.doc_id > m.first),
x AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id),
y AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM d),
z AS (SELECT y.doc_id, string_agg(word, ' ' ORDER BY y.i) AS kept FROM y LEFT JOIN r ON r.doc_id = y.doc_id AND r.i = y.i
      WHERE r.i IS NULL GROUP BY y.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN z USING (doc_id)"""


# --- 7 ---------------------------------------------------------------------------------------


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm import quality

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"), modulus=3, held_out=1)
    return quality.scores(docs, model).select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


# --- 8 ---------------------------------------------------------------------------------------


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.decontam import contaminated

    return contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


# --- 6, 9, 10 --------------------------------------------------------------------------------


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.sentencepiece_codec import digests

    return digests(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


JUNK = ("spam-farm", "cheap-pills", "casino-win", "free-bets")


def listed_pages(pages: DataFrame) -> DataFrame:
    """The URLs of all pages of the junk hosts and of their subdomains, under any domain."""
    from docloom.llm.urlfilter import host_of

    return pages.where(host_of(F.col("url")).rlike(rf"(^|\.)({'|'.join(JUNK)})\.")).select("url")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is every page of the junk hosts and their subdomains."""
    from docloom.llm.urlfilter import judge

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, listed_pages(pages)).select("page_id", "host", "path", "rule", "verdict")


def _op9_sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
    rules = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    name = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in rules)
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS key FROM p),
l AS (SELECT DISTINCT key FROM k WHERE regexp_matches(host, '(^|\\.)({'|'.join(JUNK)})\\.'))
SELECT page_id, host, path, CASE {name} END AS rule,
       CASE {verdict} WHEN key IN (SELECT key FROM l) AND key <> '' THEN 'block' ELSE 'allow' END AS verdict
FROM k"""


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.llm.tokencount import token_counts

    return token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


# --- registry --------------------------------------------------------------------------------


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_topk": op2_topk,
        "op3_ngram_jaccard": op3_ngram_jaccard,
        "op4_pii": op4_pii,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_quality": op7_quality,
        "op8_decontamination": op8_decontamination,
        "op9_url_filter": op9_url_filter,
        "op10_token_count": op10_token_count,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk": _OP2_SQL,
        "op3_ngram_jaccard": _OP3_SQL,
        "op5_substring_dedup": _OP5_SQL,
        "op9_url_filter": _op9_sql(),
    }
