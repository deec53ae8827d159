"""Queries on pages, tables of contents and structure.

The tables have no page geometry, so lines get theirs from their place: eight lines to a page, 35 units apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import pages as P
from docloom.operators import structure as G
from docloom.operators import toc as C
from docloom.plans.catalog import W, query, squeeze_sql, table, trim_sql

re2 = lambda p: p.replace("(?iu)", "(?i)").replace("'", "''")


def lines(spark: SparkSession, sf_dir: str, toc: bool = False) -> DataFrame:
    """The lines of all documents; with ``toc`` half of every twelve are dressed as a table of contents and a chapter."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    n, line = F.col("n"), F.col("line")
    k = n % 12
    text = F.when(k == 0, F.lit("Table of Contents")).when(k.between(1, 4), F.concat("line", F.lit(" ....... "), n.cast("string"))).when(k == 5, F.concat(F.lit("Chapter "), n.cast("string"), F.lit(" begins"))).otherwise(line)
    text = text if toc else line
    return d.select(
        "doc_id", F.floor(n / 8).cast("int").alias("page"), (n % 8).cast("int").alias("ord"), text.alias("text"), ((n % 8) * 35.0).alias("y"), ((n % 8) * 35.0).alias("y1"), ((n % 8) * 35.0 + 10).alias("y2"), ((n * 7) % 30).cast("double").alias("x1"), ((n * 7) % 30 + 100.0).alias("x2"),
        (F.length(line) % 6 + 10.0).alias("font_size"), F.when(n % 4 == 0, F.lit(16)).otherwise(F.lit(0)).alias("flags"), F.when(n % 5 == 0, F.lit("Title")).otherwise(F.lit("Text")).alias("label"),
    )


_LINES = lambda text: f"""ln AS (SELECT doc_id, CAST(n // 8 AS INTEGER) AS page, CAST(n % 8 AS INTEGER) AS ord, {text} AS text,
 CAST((n % 8) * 35 AS DOUBLE) AS y1, CAST((n * 7) % 30 AS DOUBLE) AS x1, CAST(length(line) % 6 + 10 AS DOUBLE) AS font_size, CASE WHEN n % 5 = 0 THEN 'Title' ELSE 'Text' END AS label
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents))"""  # noqa: E731
LINES = _LINES("line")
TOC_LINES = _LINES("CASE WHEN n % 12 = 0 THEN 'Table of Contents' WHEN n % 12 BETWEEN 1 AND 4 THEN line || ' ....... ' || n WHEN n % 12 = 5 THEN 'Chapter ' || n || ' begins' ELSE line END")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))


_ENTRY = f"(length({trim_sql('text')}) >= 5 AND regexp_matches({trim_sql('text')}, '{re2(C.ENTRY)}'))"
_CONTENT = f"(length({trim_sql('text')}) >= 3 AND regexp_matches(lower({trim_sql('text')}), '{re2(C.CONTENT)}'))"
_KEY = f"regexp_matches(text, '{re2(C.keyword_pattern())}')"


@query(f"WITH {TOC_LINES} SELECT doc_id, page, count(*) AS n FROM ln WHERE {_ENTRY} GROUP BY ALL")
def toc_entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, toc=True).where(C.is_entry(F.col("text"))).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOC_LINES} SELECT doc_id, page, count(*) AS n FROM ln WHERE {_CONTENT} GROUP BY ALL")
def content_start_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir, toc=True).where(C.is_content_start(F.col("text"))).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))


_START = f"st AS (SELECT doc_id, page AS start_page, min_by(y1, ord) AS start_y, min_by(text, ord) AS matched_text FROM ln WHERE {_KEY} GROUP BY ALL)"


@query(f"WITH {TOC_LINES}, {_START} SELECT * FROM st")
def toc_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.starts(lines(spark, sf_dir, toc=True))


_END = f"""sz AS (SELECT doc_id, max(page) + 1 AS pages FROM ln GROUP BY doc_id),
rw AS (SELECT st.doc_id, start_page, start_y, page, ord, y1 AS y, {_ENTRY} AS entry, {_CONTENT} AS begins FROM st JOIN ln ON ln.doc_id = st.doc_id AND page BETWEEN start_page AND start_page + 2
   WHERE (page > start_page OR y1 > start_y) AND length({trim_sql('text')}) >= 3),
ru AS (SELECT *, count(*) OVER w AS total, count(*) FILTER (entry) OVER w AS entries FROM rw WINDOW w AS (PARTITION BY doc_id, start_page ORDER BY page, ord ROWS UNBOUNDED PRECEDING)),
sp AS (SELECT doc_id, start_page, min_by(page, page * 100 + ord) AS p, min_by(y, page * 100 + ord) AS y, min_by(entries, page * 100 + ord) AS e, min_by(total, page * 100 + ord) AS t FROM ru
   WHERE NOT entry AND begins AND entries / total >= 0.3 GROUP BY ALL),
al AS (SELECT doc_id, start_page, count(*) FILTER (entry) AS e, count(*) AS t, max_by(y, page * 100 + ord) FILTER (entry) AS ly FROM ru GROUP BY ALL),
en AS (SELECT doc_id, start_page, start_y, CAST(coalesce(sp.p, start_page + least(2, pages - start_page - 1)) AS INTEGER) AS end_page, CAST(coalesce(sp.y, coalesce(ly, start_y) + 50) AS DOUBLE) AS end_y,
   coalesce(sp.e, al.e, 0) AS entry_count, coalesce(sp.t, al.t, 0) AS total_lines, round(coalesce(sp.e, al.e, 0) / greatest(1, coalesce(sp.t, al.t, 0)), 6) AS toc_ratio,
   CASE WHEN sp.p IS NOT NULL THEN 'content_start' ELSE 'fallback' END AS end_method
   FROM st JOIN sz USING (doc_id) LEFT JOIN sp USING (doc_id, start_page) LEFT JOIN al USING (doc_id, start_page))"""


@query(f"WITH {TOC_LINES}, {_START}, {_END} SELECT * FROM en")
def toc_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir, toc=True)
    return C.ends(C.starts(x), x)


@query(f"WITH {TOC_LINES}, {_START}, {_END} SELECT doc_id, start_page, CASE WHEN end_page - start_page <= 1 THEN 'certain' WHEN end_page - start_page <= 5 THEN 'uncertain' ELSE 'rejected' END AS category, entry_count > 0 AS ready_for_splitting FROM en")
def toc_categorise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.detect(lines(spark, sf_dir, toc=True)).select("doc_id", "start_page", "category", "ready_for_splitting")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries from conversations: a turn is an entry, its text the title, its page from its length."""
    c = table(spark, sf_dir, "conversations")
    page = F.when(F.col("turn") % 7 == 6, F.lit(None).cast("int")).otherwise((F.length("text") % 40).cast("int"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), F.col("text").alias("title"), page.alias("page"), F.when(F.col("turn") % 5 == 4, F.lit(None).cast("int")).otherwise(F.lit(1)).alias("level"))


_ENTRIES = "en AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS ord, text AS title, CASE WHEN turn % 7 = 6 THEN NULL ELSE CAST(length(text) % 40 AS INTEGER) END AS page, CASE WHEN turn % 5 = 4 THEN NULL ELSE 1 END AS level FROM conversations)"


@query(f"""WITH {_ENTRIES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, title, page ORDER BY ord) AS n FROM en WHERE level IS NOT NULL)
SELECT doc_id, title, page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(nullif(page, 0), 999999), ord) AS INTEGER) AS place FROM f WHERE n = 1""")
def toc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merged(C.usable_entries(_entries(spark, sf_dir))).select("doc_id", "title", "page", "place")


@query(f"WITH {_ENTRIES} SELECT doc_id, avg(CASE WHEN page BETWEEN 1 AND 30 THEN 0 ELSE 1 END) <= 0.2 AS bounds_ok FROM en GROUP BY doc_id")
def toc_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return C.bounds_ok(e, e.select("doc_id", F.lit(30).alias("pages")).distinct())


@query(f"""WITH {_ENTRIES}, l AS (SELECT doc_id, page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page, ord) - 1, 40) - page + 1 AS n FROM en WHERE page IS NOT NULL)
SELECT doc_id, avg(CAST(n <= 2 AS INT)) <= 0.5 AND avg(CAST(n > 32 AS INT)) <= 0.2 AND count(DISTINCT page) = count(page) AS boundaries_ok FROM l GROUP BY doc_id""")
def toc_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    return C.boundaries_ok(e, e.select("doc_id", F.lit(40).alias("pages")).distinct())


@query(f"""WITH {_ENTRIES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page NULLS FIRST, ord) - 4 AS i FROM en), s AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM r WHERE i >= 0)
SELECT doc_id, ord FROM s WHERE n <= 4 OR (i % (n // 4) = 0 AND i // (n // 4) < 4)""")
def toc_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sample(_entries(spark, sf_dir)).select("doc_id", "ord")


@query("""WITH RECURSIVE v AS (SELECT conv_id AS doc_id, turn AS ord, count(*) OVER (PARTITION BY conv_id) AS n, CASE length(text) % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'failed' END AS outcome FROM conversations),
w AS (SELECT doc_id, ord, n, outcome, CAST(outcome = 'rejected' AS INT) AS bad, CAST(outcome = 'failed' AS INT) AS broken FROM v WHERE ord = 0
  UNION ALL SELECT v.doc_id, v.ord, v.n, v.outcome, CASE WHEN v.outcome = 'rejected' THEN bad + 1 ELSE 0 END, CASE v.outcome WHEN 'accepted' THEN 0 WHEN 'failed' THEN broken + 1 ELSE broken END
  FROM w JOIN v ON v.doc_id = w.doc_id AND v.ord = w.ord + 1 WHERE bad < 2 AND broken < 2)
SELECT doc_id, ord FROM w WHERE outcome = 'accepted' AND n <= 25""")
def toc_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stops after two rejections in a row or two failures."""
    k = F.length("text") % 3
    v = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.when(k == 0, F.lit("accepted")).when(k == 1, F.lit("rejected")).otherwise(F.lit("failed")).alias("outcome"))
    return C.accepted(v, rejections=2, failures=2).select("doc_id", "ord")


@query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS ord FROM conversations WHERE turn % 4 = 2")
def toc_substantive(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 4
    title = F.when(k == 0, F.concat(F.lit("Introduction "), "role")).when(k == 1, F.lit("Table of CONTENTS")).when(k == 2, F.concat(F.lit("About "), "role")).otherwise(F.lit("Index"))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), title.alias("title"))
    return C.substantive(c).select("doc_id", "ord")


@query(f"""WITH {_ENTRIES}, b AS (SELECT doc_id, avg(CASE WHEN page BETWEEN 1 AND 40 THEN 0 ELSE 1 END) <= 0.2 AS bo, count(*) AS n FROM en GROUP BY doc_id),
l AS (SELECT doc_id, page, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page, ord) - 1, 40) - page + 1 AS k FROM en WHERE page IS NOT NULL),
s AS (SELECT doc_id, avg(CAST(k <= 2 AS INT)) <= 0.5 AND avg(CAST(k > 32 AS INT)) <= 0.2 AND count(DISTINCT page) = count(page) AS so FROM l GROUP BY doc_id),
t AS (SELECT conv_id AS doc_id, avg(CAST(length(text) % 2 = 0 AS INT)) AS rate FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT b.doc_id, bo AND (coalesce(so, false) OR n < 4 OR rate IS NULL OR rate >= 0.75) AS valid FROM b LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)""")
def toc_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, then boundaries or content; content is tested by a stand-in for similarity on the user's turns."""
    e = _entries(spark, sf_dir)
    pages = e.select("doc_id", F.lit(40).alias("pages")).distinct()
    tested = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc_id"), (F.length("text") % 2 == 0).alias("matches"))
    counts = e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return C.is_valid(C.bounds_ok(e, pages), C.boundaries_ok(e, pages), C.content_ok(tested, counts))


@query(f"WITH {LINES} SELECT doc_id, page, ord, CASE WHEN y1 <= 0.05 * 280 THEN 0.0 ELSE greatest(0.0, y1 - 10) END AS top FROM ln")
def section_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", "page", "ord", G.crop_top(F.col("y1"), 280.0).alias("top"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    y = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return e.select(F.lit(0).alias("doc_id"), F.col("user_id").alias("page"), F.lit(0.0).alias("x1"), y.alias("y1"), F.lit(50.0).alias("x2"), (y + F.col("value") * 100).alias("y2"), F.col("event_type").alias("label"), F.lit(0.5).alias("confidence"))


@query("""WITH b AS (SELECT user_id AS page, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS y1, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) + value * 100 AS y2, event_type AS label FROM events),
l AS (SELECT *, CASE WHEN y1 - lag(y2) OVER w < 600 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY page ORDER BY y1, y2)),
i AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y1, y2 ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT page, min(y1) AS y1, max(y2) AS y2, count(*) AS merged_count, CASE WHEN count(*) > 1 THEN 'merged' ELSE min(label) END AS label FROM i GROUP BY page, island HAVING round(50 * (max(y2) - min(y1)), 6) > 100""")
def block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.merge_blocks(_blocks(spark, sf_dir), gap=600).select("page", "y1", "y2", "merged_count", "label")


@query(f"""WITH {LINES}, bx AS (SELECT doc_id, page, y1 - 5 AS y1, y1 + 6 AS y2, label || ord AS label FROM ln WHERE ord % 2 = 0 UNION ALL SELECT doc_id, page, y1 - 5, y1 + 3, 'Early' FROM ln WHERE ord % 4 = 0),
j AS (SELECT a.doc_id, a.page, a.ord, round(greatest(0.0, least(a.y1 + 10, b.y2) - greatest(a.y1, b.y1)) / 10, 9) AS s, b.label FROM ln a JOIN bx b ON a.doc_id = b.doc_id AND a.page = b.page),
m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, ord ORDER BY s DESC, label) AS n FROM j WHERE s > 0)
SELECT doc_id, page, ord, coalesce(m.label, 'Text') AS label FROM ln LEFT JOIN (SELECT doc_id, page, ord, label FROM m WHERE n = 1) m USING (doc_id, page, ord)""")
def layout_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    box = lambda rows, up, label: rows.select("doc_id", "page", F.lit(-100.0).alias("x1"), F.lit(1000.0).alias("x2"), (F.col("y1") - 5).alias("y1"), (F.col("y1") + up).alias("y2"), label.alias("label"))
    boxes = box(x.where("ord % 2 = 0"), 6, F.concat("label", F.col("ord").cast("string"))).union(box(x.where("ord % 4 = 0"), 3, F.lit("Early")))
    return G.assign_labels(x, boxes).select("doc_id", "page", "ord", "label")


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_STATS = f"""fo AS (SELECT doc_id, round(avg(font_size), 6) AS mean_font, round(quantile_cont(font_size, 0.5), 6) AS median_font FROM ln GROUP BY doc_id),
bo AS (SELECT doc_id, x1, count(*) AS n, min(page * 100 + ord) AS seen FROM ln WHERE {_WORDS} > 2 GROUP BY ALL),
bi AS (SELECT doc_id, x1 AS indent FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen) AS k FROM bo) WHERE k = 1),
ds AS (SELECT doc_id, mean_font, median_font, coalesce(indent, 0.0) AS indent FROM fo LEFT JOIN bi USING (doc_id))"""


@query(f"WITH {LINES}, {_STATS} SELECT * FROM ds")
def layout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.document_stats(lines(spark, sf_dir)).select("doc_id", "mean_font", "median_font", "indent")


_SCORE = f"""ab AS (SELECT *, y1 - lag(y1) OVER w AS above, lead(y1) OVER w - y1 AS below FROM ln JOIN ds USING (doc_id) WINDOW w AS (PARTITION BY doc_id, page ORDER BY y1, ord)),
sc AS (SELECT *, CASE WHEN font_size > mean_font * 1.3 THEN 3 WHEN font_size > mean_font * 1.1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(text, '{re2(G.NUMBERING)}') THEN 4 ELSE 0 END
  + CASE WHEN x1 < indent - 10 THEN 2 ELSE 0 END + CASE WHEN x1 = 0 THEN 1 ELSE 0 END + CASE WHEN {_WORDS} BETWEEN 2 AND 12 THEN 1 ELSE 0 END + CASE WHEN label IN ('Title', 'Header') THEN 3 ELSE 0 END
  + CASE WHEN coalesce(above > 30, true) AND coalesce(below > 30, true) THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '{G.HEADER_WORDS}') THEN 1 ELSE 0 END AS score FROM ab)"""


@query(f"WITH {LINES}, {_STATS}, {_SCORE} SELECT doc_id, page, ord, CAST(score AS INTEGER) AS score, CAST(round(least(score / 8.0, 1.0), 6) AS DOUBLE) AS header_confidence FROM sc WHERE score >= 5")
def header_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    return G.headers(x, G.document_stats(x)).select("doc_id", "page", "ord", "score", "header_confidence")


_LEVEL = f"""hd AS (SELECT *, lead(page) OVER w AS np, lead(y1) OVER w AS ny FROM sc WHERE score >= 5 WINDOW w AS (PARTITION BY doc_id ORDER BY page, y1, ord)),
pg AS (SELECT doc_id, max(page) + 1 AS pages FROM ln GROUP BY doc_id),
lv AS (SELECT doc_id, text AS title, page AS start_page, y1 AS start_y, CAST(coalesce(np, pages - 1) AS INTEGER) AS end_page, CASE WHEN np = page THEN ny END AS end_y FROM hd JOIN pg USING (doc_id)
   WHERE score >= 6 OR regexp_matches(text, '{re2(G.STRONG)}') OR label = 'Title' OR font_size > 20)"""


@query(f"WITH {LINES}, {_STATS}, {_SCORE}, {_LEVEL} SELECT * FROM lv")
def level1_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    return G.level_one(G.headers(x, G.document_stats(x)), _pages(spark, sf_dir))


@query(f"""WITH {LINES}, {_STATS}, {_SCORE}, {_LEVEL},
ins AS (SELECT lv.*, ln.page, ln.ord FROM lv JOIN ln ON ln.doc_id = lv.doc_id AND ln.page BETWEEN start_page AND end_page WHERE (ln.page > start_page OR y1 >= start_y) AND (ln.page < end_page OR end_y IS NULL OR y1 <= end_y))
SELECT doc_id, start_page, start_y, count(*) AS lines FROM ins GROUP BY ALL""")
def section_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    return G.content(level1_sections(spark, sf_dir), x).groupBy("doc_id", "start_page", "start_y").agg(F.count(F.lit(1)).alias("lines"))


@query(f"""WITH m AS (SELECT doc_id, list_transform(regexp_extract_all(' ' || regexp_replace(text, '[^0-9\\p{{L}}_]', '  ', 'g') || ' ', '[^0-9\\p{{L}}_]([0-9]{{1,4}})[^0-9\\p{{L}}_]', 1), lambda x: CAST(x AS INTEGER)) AS n FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(n, lambda x: x >= 1))), ',') AS page_numbers FROM m""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat_ws(",", F.transform(T.page_mentions(F.col("text")), lambda x: x.cast("string"))).alias("page_numbers"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from lines: whole, with words around, and shuffled; some that are nowhere."""
    x = lines(spark, sf_dir).where("ord = 3")
    w = F.filter(F.split("text", r"\s+"), lambda t: t != "")
    k = F.col("page") % 4
    title = F.when(k == 0, F.substring("text", 3, 30)).when(k == 1, F.concat(F.lit("zz "), F.array_join(F.slice(w, 1, 5), " "), F.lit(" zz"))).when(k == 2, F.concat_ws(" ", F.reverse(F.slice(w, 1, 6)))).otherwise(F.lit("qqq www"))
    return x.where("text <> ''").select("doc_id", F.col("page").alias("ord"), title.alias("title"), "page")


_NORM = lambda x: squeeze_sql(f"lower(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_' || '{W[1:-1]}' || ']', ' ', 'g'))")
_PLACES = f"""tw AS (SELECT doc_id, page, page AS entry, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS w FROM ln WHERE ord = 3 AND text <> ''),
ti AS (SELECT doc_id, page, entry, CASE page % 4 WHEN 0 THEN substr(text, 3, 30) WHEN 1 THEN 'zz ' || array_to_string(w[1:5], ' ') || ' zz' WHEN 2 THEN array_to_string(list_reverse(w[1:6]), ' ') ELSE 'qqq www' END AS title FROM tw),
t2 AS (SELECT *, list_filter(regexp_split_to_array(title, '\\s+'), lambda t: t <> '') AS w, list_distinct(list_filter(string_split({_NORM('title')}, ' '), lambda t: t <> '')) AS bag FROM ti),
t3 AS (SELECT *, CASE WHEN len(w) >= 5 THEN {_NORM("array_to_string(w[2:len(w) - 1], ' ')")} END AS c1, CASE WHEN len(w) >= 7 THEN {_NORM("array_to_string(w[3:len(w) - 2], ' ')")} END AS c2 FROM t2),
jn AS (SELECT t3.*, ln.ord AS o, ln.y1, ln.text AS lt, {_NORM('ln.text')} AS nt FROM t3 JOIN ln USING (doc_id, page)),
js AS (SELECT *, CASE WHEN len(bag) >= 2 THEN round(len(list_intersect(bag, string_split(nt, ' '))) / len(bag), 9) END AS r FROM jn),
pl AS (SELECT doc_id, entry, title, page, min_by(y1, o) FILTER (contains(lt, title)) AS e, min_by(y1, o) FILTER (contains(nt, c1)) AS a, min_by(y1, o) FILTER (contains(nt, c2)) AS b, min_by(y1, (1 - r) * 1000 + o / 100) FILTER (r >= 0.8) AS g FROM js GROUP BY ALL)"""


@query(f"WITH {LINES}, {_PLACES} SELECT doc_id, entry, coalesce(e, a, b, g) AS y, CASE WHEN e IS NOT NULL THEN 'exact' WHEN coalesce(a, b) IS NOT NULL THEN 'truncated' WHEN g IS NOT NULL THEN 'words' END AS step FROM pl")
def title_wordbag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.title_places(_titles(spark, sf_dir), lines(spark, sf_dir)).select("doc_id", "entry", "y", "step")


_POINTS = "po AS (SELECT doc_id, page, coalesce(e, a, b, g) IS NOT NULL AS precise, coalesce(e, a, b, g, 0.0) AS y, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, coalesce(e, a, b, g, 0.0), entry) - 1 AS INTEGER) AS section FROM pl)"


@query(f"WITH {LINES}, {_PLACES}, {_POINTS} SELECT doc_id, section, page, y, precise FROM po")
def start_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.start_points(G.title_places(_titles(spark, sf_dir), lines(spark, sf_dir)).select("doc_id", "entry", "title", "page", F.col("y"))).select("doc_id", "section", "page", "y", "precise")


_VEC = lambda x: f"(SELECT list_transform(c, lambda z: CASE WHEN sqrt(list_sum(list_transform(c, lambda t: t * t))) > 0 THEN round(z / sqrt(list_sum(list_transform(c, lambda t: t * t))), 9) ELSE 0.0 END) FROM (SELECT list_transform(range(26), lambda k: CAST(length({x}) - length(replace(lower({x}), chr(CAST(97 + k AS INT)), '')) AS DOUBLE)) AS c))"


@query(f"""WITH {LINES}, {_PLACES}, le AS (SELECT doc_id, entry, title, page, {_VEC('title')} AS q FROM pl WHERE coalesce(e, a, b, g) IS NULL),
ow AS (SELECT doc_id, page, ord, y1, (page * 8 + ord) % 4 = 0 OR font_size > 1.1 * avg(font_size) OVER (PARTITION BY doc_id, page) AS marked, {_VEC('text')} AS v FROM ln),
bo AS (SELECT le.doc_id, entry, le.page, ord, y1, marked, greatest(0.0, least(1.0, round(list_sum(list_transform(list_zip(q, v), lambda z: z[1] * z[2])), 9))) AS s FROM le JOIN ow ON ow.doc_id = le.doc_id AND ow.page = le.page),
ju AS (SELECT *, round(s - lag(s) OVER (PARTITION BY doc_id, entry, page ORDER BY ord), 9) > 0.3 AND s > 0.5 AS jump FROM bo),
fi AS (SELECT doc_id, entry, page, min_by(y1, (1 - s) * 1000 + ord / 1e7) FILTER (marked AND s >= 0.6) AS vi, min_by(y1, ord) FILTER (jump) AS j FROM ju GROUP BY ALL)
SELECT doc_id, entry, page, coalesce(vi, j) AS y, CASE WHEN vi IS NOT NULL THEN 'visual' ELSE 'jump' END AS step FROM fi WHERE coalesce(vi, j) IS NOT NULL""")
def title_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir)
    return G.semantic_places(G.title_places(_titles(spark, sf_dir), x), x)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = G.title_places(_titles(spark, sf_dir), lines(spark, sf_dir)).drop("step")
    return G.sequential(G.start_points(places), _pages(spark, sf_dir))


_SEQ = """sq AS (SELECT po.doc_id, section, page AS start_page, y AS start_y, CAST(coalesce(lead(page) OVER w, pages) AS INTEGER) AS end_page, coalesce(lead(y) OVER w, 0.0) AS end_y, CASE WHEN precise THEN 'precise' ELSE 'page' END AS precision
 FROM po JOIN (SELECT doc_id, max(page) + 1 AS pages FROM ln GROUP BY doc_id) z ON z.doc_id = po.doc_id WINDOW w AS (PARTITION BY po.doc_id ORDER BY section))"""


@query(f"WITH {LINES}, {_PLACES}, {_POINTS}, {_SEQ} SELECT * FROM sq")
def section_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir).drop("title")


@query(f"WITH {LINES}, {_PLACES}, {_POINTS}, {_SEQ} SELECT precision, count(*) AS n FROM sq GROUP BY precision")
def section_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.section_stats(_sections(spark, sf_dir))


@query(f"""WITH {LINES}, {_PLACES}, {_POINTS}, {_SEQ}
SELECT sq.doc_id, section, string_agg(text, chr(10) ORDER BY ln.page, ord) AS text, count(*) AS lines FROM sq JOIN ln ON ln.doc_id = sq.doc_id AND ln.page BETWEEN start_page AND end_page
WHERE (ln.page > start_page OR y1 >= start_y) AND (ln.page < end_page OR y1 < end_y) GROUP BY ALL""")
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.section_text(_sections(spark, sf_dir), lines(spark, sf_dir))


@query(f"""WITH {TOC_LINES}, {_STATS}, {_SCORE}, nu AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS n FROM ln),
h AS (SELECT sc.doc_id, sc.page AS hp, sc.ord AS ho, n AS hn FROM sc JOIN nu USING (doc_id, page, ord) WHERE score >= 5 AND regexp_matches(lower(sc.text), 'contents')),
f AS (SELECT h.*, n, page, text, {_ENTRY} AS entry FROM h JOIN nu ON nu.doc_id = h.doc_id AND n BETWEEN hn + 1 AND hn + 50),
s AS (SELECT *, count(*) FILTER (entry) OVER (PARTITION BY doc_id, hn ORDER BY n ROWS UNBOUNDED PRECEDING) AS so FROM f),
t AS (SELECT *, max(CAST(so > 0 AND NOT entry AND NOT regexp_matches(text, '[0-9]') AS INT)) OVER (PARTITION BY doc_id, hn ORDER BY n ROWS UNBOUNDED PRECEDING) AS stop FROM s)
SELECT doc_id, hp, ho, count(*) FILTER (entry) AS entries, max(page) AS end_page FROM t WHERE stop = 0 GROUP BY ALL HAVING count(*) FILTER (entry) >= 3""")
def toc_after_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(spark, sf_dir, toc=True)
    return G.toc_after_headers(G.headers(x, G.document_stats(x)), x, "contents")


# --- pages -----------------------------------------------------------------------------------


def conv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents: a turn is a page with a header line, and each seventh turn failed."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.when(F.col("turn") % 7 == 6, F.lit("error")).otherwise(F.lit("success")).alias("status"), F.concat(F.lit("Report of conversation\n"), "text", F.lit("\n\n\n\n| a | b |\n  "), F.col("role")).alias("text"))


CONV = "pg AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, CASE WHEN turn % 7 = 6 THEN 'error' ELSE 'success' END AS status, 'Report of conversation' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || '| a | b |' || chr(10) || '  ' || role AS text FROM conversations)"


@query(f"WITH {CONV} SELECT doc_id, string_agg({trim_sql('text')} || chr(10), chr(10) ORDER BY page) AS text FROM pg WHERE status = 'success' GROUP BY doc_id")
def pages_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.combine(conv_pages(spark, sf_dir).where("status = 'success'"))


@query(f"""WITH {CONV} SELECT doc_id, count(*) AS pages, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status <> 'success') AS failed,
round(count(*) FILTER (status = 'success') / count(*), 6) AS success_rate, count(*) FILTER (length(text) - length(replace(text, '|', '')) >= 4) AS with_tables,
CAST(coalesce(sum(length(text)) FILTER (status = 'success'), 0) AS BIGINT) AS total_length, CAST(coalesce(floor(avg(length(text)) FILTER (status = 'success')), 0) AS BIGINT) AS mean_length FROM pg GROUP BY doc_id""")
def pages_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.statistics(conv_pages(spark, sf_dir))


@query(f"WITH {CONV} SELECT doc_id, page FROM pg WHERE status <> 'success'")
def pages_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conv_pages(spark, sf_dir)
    return P.to_do(p, p).select("doc_id", "page")


@query(f"WITH {CONV} SELECT doc_id, page, length(text) - length(replace(text, '|', '')) >= 4 AS has_tables FROM pg")
def pages_table_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_pages(spark, sf_dir).select("doc_id", "page", T.has_table(F.col("text")).alias("has_tables"))


_FURN = f"""fl AS (SELECT doc_id, page, {trim_sql('line')} AS line FROM (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line FROM pg WHERE status = 'success')),
fu AS (SELECT doc_id, line AS fragment, count(DISTINCT page) AS pages, min(page) AS first FROM fl WHERE length(line) >= 5 GROUP BY ALL),
fr AS (SELECT doc_id, fragment, pages FROM fu WHERE pages >= 2 AND first IN (SELECT x FROM (SELECT doc_id AS d, unnest(list_sort(list(DISTINCT page))[1:5]) AS x FROM pg GROUP BY doc_id) WHERE d = fu.doc_id))"""


@query(f"WITH {CONV}, {_FURN} SELECT * FROM fr")
def header_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.furniture(conv_pages(spark, sf_dir))


@query(f"WITH {CONV}, {_FURN} SELECT doc_id, fragment, count(DISTINCT page) AS pages FROM fr JOIN (SELECT doc_id, page, text FROM pg WHERE status = 'success') USING (doc_id) WHERE contains(text, fragment) GROUP BY ALL HAVING count(DISTINCT page) >= 2")
def header_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conv_pages(spark, sf_dir)
    return P.verified(P.furniture(p).select("doc_id", "fragment"), p)


@query(f"""WITH RECURSIVE {CONV}, {_FURN}, li AS (SELECT doc_id, list(fragment ORDER BY length(fragment) DESC, fragment) AS f FROM fr GROUP BY doc_id),
go AS (SELECT doc_id FROM pg WHERE status = 'success' GROUP BY doc_id HAVING count(*) >= 2),
cu AS (SELECT doc_id, page, text, f, 1 AS k FROM pg JOIN li USING (doc_id) JOIN go USING (doc_id) WHERE status = 'success' UNION ALL SELECT doc_id, page, replace(text, f[k], ''), f, k + 1 FROM cu WHERE k <= len(f)),
ok AS (SELECT doc_id, page, {trim_sql("regexp_replace(regexp_replace(text, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g')")} AS clean FROM cu WHERE k = len(f) + 1)
SELECT doc_id, page, coalesce(clean, text) AS clean FROM pg LEFT JOIN ok USING (doc_id, page)""")
def header_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conv_pages(spark, sf_dir)
    return P.without_furniture(p, P.furniture(p)).select("doc_id", "page", "clean")


@query(f"""WITH {CONV}, w AS (SELECT doc_id, page, '```markdown' || chr(10) || CASE WHEN page % 3 = 0 THEN 'x' ELSE text END || chr(10) || '```' AS t FROM pg),
s AS (SELECT doc_id, page, {trim_sql("regexp_replace(CASE WHEN t <> '' THEN substr(t, 13, length(t) - 16) END, '[ \\t]+(\\n|$)', '\\1', 'g')")} AS m FROM w)
SELECT doc_id, page, CASE WHEN length(m) < 10 THEN '*[no content]*' ELSE m END AS markdown FROM s""")
def md_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.concat(F.lit("```markdown\n"), F.when(F.col("page") % 3 == 0, F.lit("x")).otherwise(F.col("text")), F.lit("\n```"))
    return conv_pages(spark, sf_dir).select("doc_id", "page", T.clean_markdown(reply).alias("markdown"))


@query(f"""WITH l AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{3000}}]', ' ', 'g'), ' +', ' ', 'g'), '\\.{{3,}}', '...', 'g'), chr(10)) AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(l, lambda x: {trim_sql('x')}), lambda x: x <> ''), chr(10)) AS text FROM l""")
def page_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_page_text(F.col("text")).alias("text"))
