"""Queries on cleaning and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators.providers import LineSectioner
from docloom.plans.catalog import query, squeeze_sql, table, trim_sql
from docloom.sources.documents import route, valid_text

E_SIZE, E_OVER = 1000, 200


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, {trim_sql(f'''array_to_string(list_transform(string_split(text, chr(10)), lambda l: {squeeze_sql('l')}), chr(10))''')} AS text FROM documents")
def doc_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.cleanup_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, octet_length(encode({trim_sql('text')})) BETWEEN 1 AND 52428800 AS valid FROM documents")
def doc_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", valid_text(F.col("text")).alias("valid"))


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '\\.(md|txt)$') THEN 'text' WHEN ends_with(p, '.pdf') THEN 'pdf' ELSE 'unsupported' END AS route
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url || '.md' WHEN 1 THEN url || '.PDF' WHEN 2 THEN url || '.txt' ELSE url END AS u, lower(u) AS p FROM pages)""")
def doc_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat("url", F.lit(".md"))).when(k == 1, F.concat("url", F.lit(".PDF"))).when(k == 2, F.concat("url", F.lit(".txt"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", route(url).alias("route"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\s]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS doc_name,
CASE WHEN f = '' THEN 'section' ELSE f END AS file_name
FROM (SELECT page_id, url, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\s]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 50) AS f FROM pages)""")
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.doc_name(F.col("url")).alias("doc_name"), T.file_name(F.col("url")).alias("file_name"))


_CHUNK_LINE = """WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
c AS (SELECT doc_id, ls, unnest(generate_series(0, CAST(ceil(len(ls) / 10.0) AS INT) - 1)) AS i FROM l),
t AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, array_to_string(ls[i * 10 + 1:i * 10 + 10], chr(10)) AS text FROM c),
s AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM t)
SELECT doc_id, chunk_id, start, CAST(start + length(text) AS INTEGER) AS "end", text FROM s"""


@query(_CHUNK_LINE)
def chunk_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_lines(_docs(spark, sf_dir))


def _aware_sql(smart: bool) -> str:
    size, step = E_SIZE, E_SIZE - E_OVER
    end = "raw"
    if smart:
        end = f"""CASE WHEN raw < n AND raw > lo AND best > start + {size // 2} THEN best ELSE raw END"""
    return f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT *, unnest(generate_series(0, n // {step})) AS i FROM d),
w AS (SELECT *, i * {step} AS start, least(i * {step} + {size}, n) AS raw FROM c WHERE i * {step} < n AND (i = 0 OR i * {step} - {step} + {size} < n)),
x AS (SELECT *, greatest(raw - 200, start + {size // 2}) AS lo FROM w),
r AS (SELECT *, substr(text, lo + 1, greatest(raw - lo, 0)) AS r FROM x),
b AS (SELECT *, greatest(CASE WHEN strpos(reverse(r), ' ') > 0 THEN lo + length(r) - strpos(reverse(r), ' ') + 1 END,
   nullif(lo + length(regexp_extract(r, '(?s)^(.*[.!?]\\n)', 1)), lo), nullif(lo + length(regexp_extract(r, '(?s)^((?:.*?\\n\\n)+)', 1)), lo)) AS best FROM r),
e AS (SELECT *, {end} AS fin FROM b)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, CAST(start AS INTEGER) AS start, CAST(fin AS INTEGER) AS "end", substr(text, start + 1, fin - start) AS text, i > 0 AS overlap_start, fin < n AS overlap_end FROM e"""


@query(_aware_sql(False))
def chunk_model_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.model_aware(_docs(spark, sf_dir), E_SIZE, E_OVER, smart=False)


@query(_aware_sql(True))
def chunk_model_aware_smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.model_aware(_docs(spark, sf_dir), E_SIZE, E_OVER)


@query(f"""WITH d AS (SELECT doc_id, text, list_sort(list_distinct(list_filter(list_transform(
   list_filter(list_transform(list_filter(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))), lambda z: z[2] % 3 = 0 AND length(z[1]) > 0), lambda z: substr(z[1], 1, 20)), lambda s: s <> ''),
   lambda s: strpos(text, s) - 1), lambda p: p >= 0))) AS ps FROM documents),
e AS (SELECT doc_id, text, unnest(ps) AS a, unnest(list_concat(ps[2:], [length(text)])) AS b FROM d WHERE len(ps) > 0),
k AS (SELECT doc_id, a, b, {trim_sql('substr(text, a + 1, b - a)')} AS t FROM e),
g AS (SELECT * FROM k WHERE length(t) >= 100),
u AS (SELECT doc_id, a, b, t FROM g UNION ALL SELECT doc_id, 0, length(text), text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM g))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_id, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", t AS text FROM u""")
def chunk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_sections(_docs(spark, sf_dir), LineSectioner())


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(generate_series(0, CAST(ceil(len(w) / 150.0) AS INT) - 1)) AS i FROM d WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_id, array_to_string(w[i * 150 + 1:i * 150 + 200], ' ') AS text FROM c""")
def chunk_word_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_windows(_docs(spark, sf_dir))


_L = "list_transform(range(26), lambda k: CAST(length(s) - length(replace(lower(s), chr(CAST(97 + k AS INT)), '')) AS DOUBLE))"
_SENT = f"""r AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, '. '), lambda x: {trim_sql('x')}), lambda x: x <> '') AS raw FROM documents),
q AS (SELECT doc_id, text, raw, len(raw) AS n, unnest(raw) AS s0, unnest(range(len(raw))) AS i FROM r),
s1 AS (SELECT doc_id, i, CASE WHEN i = n - 1 AND NOT ends_with(s0, '.') THEN s0 || '.' ELSE s0 END AS s FROM q),
s2 AS (SELECT doc_id, i, CASE WHEN length(s) > 500 THEN substr(s, 1, 500) || '...' ELSE s END AS s FROM s1),
v0 AS (SELECT doc_id, i, s, {_L} AS c FROM s2),
v1 AS (SELECT *, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS norm FROM v0),
v AS (SELECT doc_id, i, s, list_transform(c, lambda x: CASE WHEN norm > 0 THEN round(x / norm, 9) ELSE 0.0 END) AS v FROM v1),
g AS (SELECT a.doc_id, a.i, round(1 - greatest(0.0, least(1.0, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])))), 9) AS d
      FROM v a JOIN v b ON b.doc_id = a.doc_id AND b.i = a.i + 1),
t AS (SELECT doc_id, round(quantile_cont(d, 0.9), 9) AS th FROM g GROUP BY doc_id),
bd AS (SELECT doc_id, i + 1 AS b FROM g JOIN t USING (doc_id) WHERE d > th)"""


@query(f"WITH {_SENT} SELECT doc_id, CAST(b AS INTEGER) AS boundary FROM bd")
def chunk_percentile_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_distances(_docs(spark, sf_dir), 90).select("doc_id", F.explode("boundaries").alias("boundary"))


@query(f"""WITH RECURSIVE {_SENT},
ln AS (SELECT doc_id, list(length(s) ORDER BY i) AS l, list(s ORDER BY i) AS ss FROM s2 GROUP BY doc_id),
bl AS (SELECT doc_id, list(b ORDER BY b) AS bs FROM bd GROUP BY doc_id),
f AS (SELECT doc_id, l, ss, bs, 1 AS k, [CAST(0 AS BIGINT)] AS cuts FROM ln JOIN bl USING (doc_id)
  UNION ALL
  SELECT doc_id, l, ss, bs, k + 1, CASE WHEN list_sum(l[cuts[-1] + 1:bs[k]]) + bs[k] - cuts[-1] - 1 >= 100 AND list_sum(l[bs[k] + 1:]) + len(l) - bs[k] - 1 >= 100
         THEN list_append(cuts, bs[k]) ELSE cuts END FROM f WHERE k <= len(bs)),
z AS (SELECT doc_id, l, ss, cuts FROM f WHERE k = len(bs) + 1 AND len(cuts) > 1),
p AS (SELECT doc_id, ss, unnest(cuts) AS a, unnest(list_concat(cuts[2:], [len(l)])) AS b FROM z),
m AS (SELECT p.doc_id, a, array_to_string(ss[a + 1:b], ' ') AS t, strpos(text, ss[a + 1]) - 1 AS st FROM p JOIN documents USING (doc_id)),
kept AS (SELECT * FROM m WHERE length(t) BETWEEN 100 AND 10000),
dr AS (SELECT doc_id, count(*) FILTER (length(t) NOT BETWEEN 100 AND 10000) AS dropped FROM m GROUP BY doc_id),
u AS (SELECT doc_id, a, st, st + length(t) AS fin, t FROM kept UNION ALL SELECT doc_id, 0, 0, length(text), text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM kept))
SELECT doc_id, CAST(coalesce(dropped, 0) AS INTEGER) AS dropped, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_id,
       CAST(st AS INTEGER) AS start, CAST(fin AS INTEGER) AS "end", t AS text FROM u LEFT JOIN dr USING (doc_id)""")
def chunk_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_percentile(_docs(spark, sf_dir), 90)


@query(f"""SELECT count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS total, round(avg(length(text)), 6) AS mean, min(length(text)) AS shortest, max(length(text)) AS longest,
count(*) FILTER (overlap_start OR overlap_end) AS overlapping FROM ({_aware_sql(False)})""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stats(chunk_model_aware(spark, sf_dir))


@query(f"""SELECT doc_id, chunk_id, CASE WHEN "end" > nx THEN substr(text, nx - start + 1, "end" - nx) END AS overlap_text FROM
(SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS nx FROM ({_aware_sql(False)})) WHERE nx IS NOT NULL""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overlaps(chunk_model_aware(spark, sf_dir))


@query(f"SELECT doc_id, chunk_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM ({_CHUNK_LINE})")
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.previews(chunk_line(spark, sf_dir))


@query(f"""SELECT doc_id, CASE WHEN length(s) <= 500 THEN s ELSE {trim_sql('substr(text, 1, 200)')} || ' ... ' || {trim_sql('right(text, 200)')} END AS text
FROM (SELECT doc_id, text, {trim_sql('text')} AS s FROM documents)""")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.edges_text(F.col("text")).alias("text"))
