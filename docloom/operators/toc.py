"""Tables of contents: where they start and end, what their entries are, and whether to trust them.

Lines are rows (doc_id, page, ord, y, text); ``ord`` orders the lines of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import trim_u

KEYWORDS = ("contents", "inhalt", "spis treści", "table des matières", "table of contents", "toc", "índice")
#: A line of a table of contents ends in a page number, after dots, wide space, a tab, numbering, or in brackets.
ENTRY = (
    r"(?iu)^(?:.+\.{3,}\s*[0-9]+\s*|.+(?:\s{3,}|\t+)[0-9]+\s*|[0-9]+\.?[0-9]*\.?\s*.+\s+[0-9]+\s*"
    r"|(?:section|chapter|część|rozdział)\s+.*[0-9]+\s*|.+\s*\([0-9]+\)\s*|[A-Z].{10,}\s[0-9]{1,3}\s*)$"
)
_LETTER = "[a-záčďéěíňóřšťúůýž]"
CONTENT = (
    r"^(?:(?:article|chapter|część|czesc|part|rozdział|rozdzial|section)\s+[0-9]+|(?:art\.|ust\.|§)\s*[0-9]+|(?:dział|księga|tytuł)\s+[ivx0-9]+"
    r"|annex|appendix|bibliografia|bibliography|conclusions|definicje|definitions|foreword|glossary|indeks|index|introduction|literatura|podsumowanie"
    r"|preface|references|schedule|slownik|summary|słownik|wnioski|wprowadzenie|wstep|wstęp|zalacznik|załącznik"
    r"|(?:hormonal|local|neuronal)\s+regulation|(?:cardiovascular|neuroendocrine|pharmacology|physiology)\s"
    rf"|[0-9]+[.)]\s+{_LETTER}|[ivx]+\.\s+{_LETTER})"
)
STOP_TITLES = ("abstract", "acknowledgments", "appendix", "bibliography", "contents", "dedication", "foreword", "index", "intro", "preface", "references")


def is_entry(text: Column) -> Column:
    s = trim_u(text)
    return (F.length(s) >= 5) & s.rlike(ENTRY)


def is_content_start(text: Column) -> Column:
    s = F.lower(trim_u(text))
    return (F.length(s) >= 3) & s.rlike(CONTENT)


def keyword_pattern(keywords: tuple[str, ...] = KEYWORDS) -> str:
    words = "|".join("".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in k) for k in keywords)
    return rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])"


def starts(lines: DataFrame, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """The first line of each page that names a table of contents: (doc_id, start_page, start_y, matched_text)."""
    hit = lines.where(F.col("text").rlike(keyword_pattern(keywords)))
    first = hit.groupBy("doc_id", "page").agg(F.min_by(F.struct("y", "text"), "ord").alias("f"))
    return first.select("doc_id", F.col("page").alias("start_page"), F.col("f.y").alias("start_y"), F.col("f.text").alias("matched_text"))


def ends(found: DataFrame, lines: DataFrame, reach: int = 3, ratio: float = 0.3) -> DataFrame:
    """Each start with the place where its table ends.

    The table goes on, over ``reach`` pages at most, until a line that starts content once at least ``ratio`` of the lines so
    far look like entries; without such a line it ends 50 below the last entry.  What a line looks like is told once,
    where it is read, and its text stays there: a line may stand in the reach of several starts.
    """
    size = lines.groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    pages = found.withColumn("page", F.explode(F.sequence(F.col("start_page"), F.col("start_page") + reach - 1)))
    text = F.col("text")
    seen = lines.where(F.length(trim_u(text)) >= 3).select("doc_id", "page", "ord", "y", is_entry(text).alias("entry"), is_content_start(text).alias("begins"))
    rows = pages.join(seen, ["doc_id", "page"]).where((F.col("page") > F.col("start_page")) | (F.col("y") > F.col("start_y")))
    w = Window.partitionBy("doc_id", "start_page").orderBy("page", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"total": F.count(F.lit(1)).over(w), "entries": F.count_if("entry").over(w)})
    stop = ~F.col("entry") & F.col("begins") & (F.col("entries") / F.col("total") >= ratio)
    at = F.struct("page", "ord")
    per = rows.groupBy("doc_id", "start_page").agg(
        F.min_by(F.struct("page", "y", "entries", "total"), F.when(stop, at)).alias("stop"), F.max_by("y", F.when(F.col("entry"), at)).alias("last_y"), F.count_if("entry").alias("entries"), F.count(F.lit(1)).alias("total")
    )
    out = found.join(per, ["doc_id", "start_page"], "left").join(size, "doc_id")
    s = F.col("stop")
    entries, total = F.coalesce(s["entries"], F.col("entries"), F.lit(0)), F.coalesce(s["total"], F.col("total"), F.lit(0))
    return out.select(
        "doc_id", "start_page", "start_y",
        F.coalesce(s["page"], F.col("start_page") + F.least(F.lit(2), F.col("pages") - F.col("start_page") - 1)).cast("int").alias("end_page"),
        F.coalesce(s["y"], F.coalesce("last_y", "start_y") + 50).cast("double").alias("end_y"),
        entries.cast("long").alias("entry_count"), total.cast("long").alias("total_lines"), F.round(entries / F.greatest(F.lit(1), total), 6).alias("toc_ratio"), F.when(s.isNotNull(), F.lit("content_start")).otherwise(F.lit("fallback")).alias("end_method"),
    )


def categorised(candidates: DataFrame) -> DataFrame:
    d = F.col("end_page") - F.col("start_page")
    return candidates.withColumn("category", F.when(d <= 1, F.lit("certain")).when(d <= 5, F.lit("uncertain")).otherwise(F.lit("rejected")))


def accepted(verdicts: DataFrame, most: int = 25, rejections: int = 4, failures: int = 3) -> DataFrame:
    """Candidates that a verifier in reading order would have accepted: (doc_id, ord, outcome) with outcome accepted,
    rejected or failed.

    More than ``most`` candidates: none.  It stops after ``rejections`` in a row, or ``failures`` since the last success.
    """
    every = Window.partitionBy("doc_id")
    w = every.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    good = F.col("outcome") == "accepted"
    rows = verdicts.withColumn("all", F.count(F.lit(1)).over(every)).withColumn("run", F.count_if(good).over(w)).withColumn("not_bad", F.count_if(F.col("outcome") != "rejected").over(w))
    streak = Window.partitionBy("doc_id", "not_bad").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("doc_id", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"bad": F.count_if(F.col("outcome") == "rejected").over(streak), "broken": F.count_if(F.col("outcome") == "failed").over(since)})
    rows = rows.withColumn("stop", F.max(((F.col("bad") >= rejections) | (F.col("broken") >= failures)).cast("int")).over(w))
    return rows.where((F.col("all") <= most) & (F.col("stop") == 0) & good).select(*verdicts.columns)


def usable_entries(entries: DataFrame) -> DataFrame:
    return entries.where("level is not null")


def merged(entries: DataFrame) -> DataFrame:
    """Entries of several tables as one: the first of each (title, page), by page with missing pages last."""
    first = F.row_number().over(Window.partitionBy("doc_id", "title", "page").orderBy("ord"))
    rows = entries.withColumn("__n", first).where("__n = 1").drop("__n")
    order = Window.partitionBy("doc_id").orderBy(F.coalesce(F.nullif("page", F.lit(0)), F.lit(999_999)), "ord")
    return rows.withColumn("place", F.row_number().over(order))


def bounds_ok(entries: DataFrame, pages: DataFrame, most: float = 0.2) -> DataFrame:
    bad = F.coalesce(~F.col("page").between(1, F.col("pages")), F.lit(True))
    return entries.join(pages, "doc_id").groupBy("doc_id").agg((F.avg(bad.cast("int")) <= most).alias("bounds_ok"))


def boundaries_ok(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Not too many tiny sections (half of at most two pages), not too many huge ones (a fifth over 80 % of the
    document), no two starts on one page."""
    w = Window.partitionBy("doc_id").orderBy("page", "ord")
    rows = entries.where("page is not null").join(pages, "doc_id").withColumn("last", F.coalesce(F.lead("page").over(w) - 1, F.col("pages")))
    n = F.col("last") - F.col("page") + 1
    return rows.groupBy("doc_id").agg(((F.avg((n <= 2).cast("int")) <= 0.5) & (F.avg((n > 0.8 * F.col("pages")).cast("int")) <= 0.2) & (F.count_distinct("page") == F.count("page"))).alias("boundaries_ok"))


def substantive(entries: DataFrame, stop: tuple[str, ...] = STOP_TITLES) -> DataFrame:
    return entries.where(~F.lower("title").rlike("|".join(stop)))


def sample(entries: DataFrame) -> DataFrame:
    """Entries to test: all but the first three if these are four at most, else four evenly spaced ones."""
    w = Window.partitionBy("doc_id")
    rows = entries.withColumn("__i", F.row_number().over(w.orderBy("page", "ord")) - 4).where("__i >= 0").withColumn("__n", F.count(F.lit(1)).over(w))
    step = F.floor(F.col("__n") / 4)
    return rows.where((F.col("__n") <= 4) | ((F.col("__i") % step == 0) & (F.col("__i") / step < 4))).drop("__i", "__n")


def content_ok(tested: DataFrame, counts: DataFrame, share: float = 0.75) -> DataFrame:
    """(doc_id, matches) of sampled titles, null where untestable, and (doc_id, n) substantive entries: fine if too few
    entries or nothing could be tested, else if at least ``share`` match."""
    t = tested.groupBy("doc_id").agg(F.avg(F.col("matches").cast("int")).alias("rate"))
    return counts.join(t, "doc_id", "left").select("doc_id", ((F.col("n") < 4) | F.col("rate").isNull() | (F.col("rate") >= share)).alias("content_ok"))


def is_valid(bounds: DataFrame, boundaries: DataFrame, content: DataFrame) -> DataFrame:
    """Bounds are a must; beyond them sound boundaries or matching content will do."""
    rows = bounds.join(boundaries, "doc_id", "left").join(content, "doc_id", "left")
    return rows.select("doc_id", (F.col("bounds_ok") & (F.coalesce("boundaries_ok", F.lit(False)) | F.coalesce("content_ok", F.lit(False)))).alias("valid"))


def detect(lines: DataFrame) -> DataFrame:
    """The whole detection: starts, ends, category, and whether the document is ready to be split."""
    return categorised(ends(starts(lines), lines)).withColumns({"method": F.lit("pattern"), "ready_for_splitting": F.col("entry_count") > 0})


def final_records(docs: DataFrame, found: DataFrame, method: str = "patterns") -> DataFrame:
    """A record per document: the first table of contents found in it with its place and method, ready for splitting if it
    has entries; or a failure with its reason."""
    first = found.groupBy("doc_id").agg(F.min_by(F.struct("start_page", "start_y", "end_page", "end_y", "entry_count"), F.struct("start_page", "start_y")).alias("t"))
    rows = docs.select("doc_id").distinct().join(first, "doc_id", "left")
    n = F.coalesce("t.entry_count", F.lit(0)).cast("int")
    reason = F.when(F.col("t").isNull(), F.lit("no table of contents")).when(n == 0, F.lit("no entries"))
    return rows.select("doc_id", "t.start_page", "t.start_y", "t.end_page", "t.end_y", n.alias("entries"), F.when(F.col("t").isNotNull(), F.lit(method)).alias("method"), (n > 0).alias("ready_for_splitting"), reason.alias("reason"))
