"""Structure from geometry: blocks, layout labels, headers, sections, and titles found on pages.

Lines are rows (doc_id, page, ord, text, x1, y1, x2, y2, font_size, flags, label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import normalise, page_mentions, preview, title_preview
from docloom.functions.vectors import rounded, similarity
from docloom.operators.providers import Embedder, LetterEmbedder

NUMBERING = r"^(?:[0-9]+\.|[\p{L}\p{N}_]+\s+[0-9]+|Art\.|Artykuł|Chapter|Rozdział|Section|§)"
STRONG = r"^(?:[0-9]+\.|Art\.|Artykuł|Chapter|Rozdział|Section)"
HEADER_WORDS = "część|definicje|ogólne|procedury|sekcja|warunki|zasady"


def merge_blocks(blocks: DataFrame, gap: float = 5.0, least_area: float = 100.0) -> DataFrame:
    """Blocks of a page that follow each other with less than ``gap`` between become one (gaps and islands); small
    results are dropped.  A lone block keeps its label, a merged one is ``merged`` with the labels it had."""
    w = Window.partitionBy("doc_id", "page").orderBy("y1", "x1", "y2", "x2")
    new = F.coalesce((F.col("y1") - F.lag("y2").over(w) >= gap).cast("int"), F.lit(1))
    rows = blocks.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("doc_id", "page", "island").agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("merged_count"), F.array_sort(F.collect_list("label")).alias("labels")
    )
    return out.withColumns({"label": F.when(F.col("merged_count") > 1, F.lit("merged")).otherwise(F.col("labels")[0]), "area": F.round((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")), 6)}).where(F.col("area") > least_area)


def _overlap(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")))
    return side("x1", "x2") * side("y1", "y2")


def assign_labels(lines: DataFrame, boxes: DataFrame, default: str = "Text") -> DataFrame:
    """Each line with the label of the box of its page that covers the greatest share of it (ties to the smaller
    label); ``default`` where none does."""
    a, b = lines.alias("a"), boxes.alias("b")
    hit = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (_overlap("a", "b") > 0), "left")
    share = _overlap("a", "b") / ((F.col("a.x2") - F.col("a.x1")) * (F.col("a.y2") - F.col("a.y1")))
    best = hit.select("a.doc_id", "a.page", "a.ord", F.round(share, 9).alias("s"), F.col("b.label").alias("l"))
    best = best.groupBy("doc_id", "page", "ord").agg(F.min_by("l", F.when(F.col("l").isNotNull(), F.struct((-F.col("s")).alias("s"), "l"))).alias("label"))
    return lines.drop("label").join(best, ["doc_id", "page", "ord"]).withColumn("label", F.coalesce("label", F.lit(default))).withColumn("confidence", F.when(F.col("flags").bitwiseAND(16) > 0, F.lit(0.8)).otherwise(F.lit(0.6)))


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def document_stats(lines: DataFrame) -> DataFrame:
    """Mean, median and range of font sizes and the commonest indent of lines of more than two words (the first seen
    among equals)."""
    fonts = lines.groupBy("doc_id").agg(F.round(F.avg("font_size"), 6).alias("mean_font"), F.round(F.percentile("font_size", 0.5), 6).alias("median_font"), F.min("font_size").alias("least_font"), F.max("font_size").alias("most_font"))
    body = lines.where(words(F.col("text")) > 2).groupBy("doc_id", "x1").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "ord")).alias("seen"))
    indent = body.groupBy("doc_id").agg(F.min_by("x1", F.struct((-F.col("n")).alias("n"), "seen")).alias("indent"))
    return fonts.join(indent, "doc_id", "left").withColumn("indent", F.coalesce("indent", F.lit(0.0)))


def scored(lines: DataFrame, stats: DataFrame, gap: float = 30.0) -> DataFrame:
    """Header score of each line: size, numbering, indent, length, label, white space around, words."""
    w = Window.partitionBy("doc_id", "page").orderBy("y1", "ord")
    rows = lines.join(stats, "doc_id").withColumns({"above": F.col("y1") - F.lag("y1").over(w), "below": F.lead("y1").over(w) - F.col("y1")})
    apart = F.coalesce(F.col("above") > gap, F.lit(True)) & F.coalesce(F.col("below") > gap, F.lit(True))
    add = lambda cond, n: F.when(cond, F.lit(n)).otherwise(F.lit(0))
    size = F.when(F.col("font_size") > F.col("mean_font") * 1.3, F.lit(3)).when(F.col("font_size") > F.col("mean_font") * 1.1, F.lit(1)).otherwise(F.lit(0))
    score = size + add(F.col("text").rlike(NUMBERING), 4) + add(F.col("x1") < F.col("indent") - 10, 2) + add(F.col("x1") == 0, 1) + add(words(F.col("text")).between(2, 12), 1)
    score = score + add(F.col("label").isin("Title", "Header"), 3) + add(apart, 2) + add(F.lower("text").rlike(HEADER_WORDS), 1)
    return rows.withColumn("score", score).drop("above", "below")


def headers(lines: DataFrame, stats: DataFrame, least: int = 5) -> DataFrame:
    return scored(lines, stats).where(F.col("score") >= least).withColumn("header_confidence", F.round(F.least(F.col("score") / 8.0, F.lit(1.0)), 6))


def level_one(found: DataFrame, pages: DataFrame, half_open: bool = False) -> DataFrame:
    """Major sections among headers: from each to the next header.

    If the next header is on another page, the section takes all of that page too, unless ``half_open``.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "y1", "ord")
    rows = found.withColumn("next", F.lead(F.struct("page", "y1")).over(w))
    top = (F.col("score") >= 6) | F.col("text").rlike(STRONG) | (F.col("label") == "Title") | (F.col("font_size") > 20)
    rows = rows.where(top).join(pages, "doc_id")
    same = F.col("next.page") == F.col("page")
    end_y = F.when(same | F.lit(half_open), F.col("next.y1")).otherwise(F.lit(None).cast("double"))
    return rows.select("doc_id", F.col("text").alias("title"), F.col("page").alias("start_page"), F.col("y1").alias("start_y"), F.coalesce("next.page", F.col("pages") - 1).cast("int").alias("end_page"), end_y.alias("end_y"))


def content(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of each section, both ends included; the page range becomes equi-join keys, one per page of a section."""
    spread = sections.withColumn("page", F.explode(F.sequence("start_page", F.greatest("start_page", "end_page"))))
    both = spread.join(lines.select("doc_id", "page", "ord", F.col("y1").alias("y"), "text"), ["doc_id", "page"])
    return both.where(((F.col("page") > F.col("start_page")) | (F.col("y") >= F.col("start_y"))) & ((F.col("page") < F.col("end_page")) | F.col("end_y").isNull() | (F.col("y") <= F.col("end_y"))))


def summaries(inside: DataFrame) -> DataFrame:
    """Sections with their number of lines, the page numbers they mention, a clean title and a preview."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))), lambda x: x["text"]), "\n")
    out = inside.groupBy("doc_id", "title", "start_page", "start_y").agg(F.count(F.lit(1)).alias("lines"), body.alias("body"))
    return out.select("doc_id", "start_page", "start_y", title_preview(F.col("title")).alias("title"), "lines", page_mentions(F.col("body")).alias("page_numbers"), preview(F.col("body"), 200).alias("preview"))


def toc_after_headers(found: DataFrame, lines: DataFrame, keywords: str, reach: int = 50, least: int = 3) -> DataFrame:
    """Headers that name a table of contents, with the entries in the next ``reach`` lines up to the first line without
    a digit that follows one; at least ``least`` are needed."""
    from docloom.operators.toc import is_entry

    h = found.where(F.lower("text").rlike(keywords)).select("doc_id", F.col("page").alias("hp"), F.col("ord").alias("ho"))
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    numbered = lines.select("doc_id", "page", "ord", "text", F.row_number().over(w).alias("n"))
    start = h.join(numbered.select("doc_id", F.col("page").alias("hp"), F.col("ord").alias("ho"), F.col("n").alias("hn")), ["doc_id", "hp", "ho"])
    both = start.withColumn("n", F.explode(F.sequence(F.col("hn") + 1, F.col("hn") + reach))).join(numbered, ["doc_id", "n"])
    both = both.withColumn("entry", is_entry(F.col("text")))
    run = Window.partitionBy("doc_id", "hn").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("so_far", F.count_if("entry").over(run)).withColumn("stop", F.max(((F.col("so_far") > 0) & ~F.col("entry") & ~F.col("text").rlike("[0-9]")).cast("int")).over(run))
    return both.where("stop = 0").groupBy("doc_id", "hp", "ho").agg(F.count_if("entry").alias("entries"), F.max("page").alias("end_page")).where(F.col("entries") >= least)


# --- titles to places, places to sections ------------------------------------------------------


def title_places(titles: DataFrame, lines: DataFrame, share: float = 0.8) -> DataFrame:
    """The place of each title (doc_id, ord, title, page) on its page by the first step that finds one.

    1. a line that contains the title; 2. its middle words (one, then two dropped at both ends), normalised; 3. the
    line that shares the greatest part of its words, ``share`` at least.  A place at 0 counts; ``y`` is null if all
    fail and the dearer steps (embeddings) are left.
    """
    t = titles.where("page is not null").withColumnRenamed("ord", "entry")
    w = F.filter(F.split("title", r"\s+"), lambda x: x != "")
    n = F.size(w)
    cut = lambda r: F.when(n >= 3 + 2 * r, normalise(F.array_join(F.slice(w, r + 1, F.greatest(n - 2 * r, F.lit(0))), " ")))
    bag = F.array_distinct(F.filter(F.split(normalise(F.col("title")), " "), lambda x: x != ""))
    t = t.withColumns({"cut1": cut(1), "cut2": cut(2), "bag": bag})
    both = t.join(lines.select("doc_id", "page", "ord", F.col("y1").alias("ly"), F.col("text").alias("lt")), ["doc_id", "page"], "left")
    both = both.withColumn("ln", normalise(F.col("lt")))
    hit = lambda c: F.min(F.when(c, F.struct("ord", "ly")))["ly"]
    ratio = F.when(F.size("bag") >= 2, F.round(F.size(F.array_intersect("bag", F.split("ln", " "))) / F.size("bag"), 9))
    best = both.groupBy("doc_id", "entry", "title", "page").agg(
        hit(F.contains("lt", F.col("title"))).alias("exact"), hit(F.contains("ln", F.col("cut1"))).alias("one"), hit(F.contains("ln", F.col("cut2"))).alias("two"), F.min(F.when(ratio >= share, F.struct((-ratio).alias("r"), "ord", "ly")))["ly"].alias("words")
    )
    step = F.when(F.col("exact").isNotNull(), F.lit("exact")).when(F.coalesce("one", "two").isNotNull(), F.lit("truncated")).when(F.col("words").isNotNull(), F.lit("words"))
    return best.select("doc_id", "entry", "title", "page", F.coalesce("exact", "one", "two", "words").alias("y"), step.alias("step"))


def semantic_places(places: DataFrame, lines: DataFrame, embedder: Embedder | None = None, least: float = 0.6, rise: float = 0.3, high: float = 0.5) -> DataFrame:
    """The last two steps for titles that have no place yet (doc_id, entry, title, page, y null).

    4. the most similar of the page's bold lines and those in type a tenth above the page's mean, if it reaches
    ``least``; 5. the first line whose similarity is more than ``rise`` above the line before and more than ``high``.
    Only unplaced titles and the lines of their pages are embedded.
    """
    embed = (embedder or LetterEmbedder()).embed
    left = places.where("y is null").select("doc_id", "entry", "title", "page", embed(F.col("title")).alias("q"))
    wanted = left.select("doc_id", "page").distinct()
    page = Window.partitionBy("doc_id", "page")
    own = lines.join(wanted, ["doc_id", "page"], "left_semi").withColumn("marked", (F.col("flags").bitwiseAND(16) > 0) | (F.col("font_size") > 1.1 * F.avg("font_size").over(page)))
    own = own.select("doc_id", "page", "ord", F.col("y1").alias("ly"), "marked", embed(F.col("text")).alias("v"))
    both = left.join(own, ["doc_id", "page"]).withColumn("s", rounded(similarity(F.col("q"), F.col("v")))).drop("q", "v")
    before = F.lag("s").over(Window.partitionBy("doc_id", "entry", "page").orderBy("ord"))
    both = both.withColumn("jump", (rounded(F.col("s") - before) > rise) & (F.col("s") > high))
    visual = F.min(F.when(F.col("marked") & (F.col("s") >= least), F.struct((-F.col("s")).alias("r"), "ord", "ly")))["ly"]
    jump = F.min(F.when(F.col("jump"), F.struct("ord", "ly")))["ly"]
    found = both.groupBy("doc_id", "entry", "page").agg(visual.alias("visual"), jump.alias("jump"))
    step = F.when(F.col("visual").isNotNull(), F.lit("visual")).when(F.col("jump").isNotNull(), F.lit("jump"))
    return found.select("doc_id", "entry", "page", F.coalesce("visual", "jump").alias("y"), step.alias("step")).where("y is not null")


def start_points(places: DataFrame) -> DataFrame:
    """Places in reading order, the top of the page where none was found."""
    w = Window.partitionBy("doc_id").orderBy("page", "y", "entry")
    return places.withColumns({"precise": F.col("y").isNotNull(), "y": F.coalesce("y", F.lit(0.0))}).withColumn("section", F.row_number().over(w) - 1)


def sequential(points: DataFrame, pages: DataFrame) -> DataFrame:
    """Half-open sections from each point to the next, the last to the document's end; equal points give empty ones."""
    w = Window.partitionBy("doc_id").orderBy("section")
    rows = points.withColumn("next", F.lead(F.struct("page", "y")).over(w)).join(pages, "doc_id")
    return rows.select("doc_id", "section", "title", F.col("page").alias("start_page"), F.col("y").alias("start_y"), F.coalesce("next.page", F.col("pages")).cast("int").alias("end_page"), F.coalesce("next.y", F.lit(0.0)).alias("end_y"), F.when(F.col("precise"), F.lit("precise")).otherwise(F.lit("page")).alias("precision"))


def section_text(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """Text of half-open sections, by equi-joins on the pages they span."""
    spread = sections.where((F.col("end_page") > F.col("start_page")) | (F.col("end_y") > F.col("start_y"))).withColumn("page", F.explode(F.sequence("start_page", "end_page")))
    both = spread.join(lines.select("doc_id", "page", "ord", F.col("y1").alias("y"), "text"), ["doc_id", "page"])
    both = both.where(((F.col("page") > F.col("start_page")) | (F.col("y") >= F.col("start_y"))) & ((F.col("page") < F.col("end_page")) | (F.col("y") < F.col("end_y"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "text"))), lambda x: x["text"]), "\n")
    return both.groupBy("doc_id", "section").agg(body.alias("text"), F.count(F.lit(1)).alias("lines"))


def crop_top(y: Column, height: float, margin: float = 10.0, near: float = 0.05) -> Column:
    """Where a cut starts: the page's top if it is near, else a little above the title."""
    return F.when(y <= near * height, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), y - margin))


def section_stats(sections: DataFrame) -> DataFrame:
    return sections.groupBy("precision").agg(F.count(F.lit(1)).alias("n"))


def page_ranges(sections: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of sections (doc_id, section, start_page, end_page; both ends included) the pages of those that can be cut out, and
    the others with a reason: a start after the end, or a page that the document (doc_id, pages) hasn't."""
    rows = sections.join(sizes, "doc_id", "left")
    reason = F.when(F.col("pages").isNull(), F.lit("no document")).when(F.col("start_page") > F.col("end_page"), F.lit("start after end"))
    reason = reason.when((F.col("start_page") < 0) | (F.col("end_page") >= F.col("pages")), F.lit("out of range"))
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select("doc_id", "section", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    return good, rows.where("reason is not null").select("doc_id", "section", "reason")
