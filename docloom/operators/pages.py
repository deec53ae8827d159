"""Pages: resume, repeated furniture, cleaning, combination and statistics.

Pages are rows (doc_id, page, status, text, ...); combining and counting group by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import cleanup_breaks, has_table, trim_u
from docloom.operators.providers import RATE_LIMIT


def to_do(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages without a successful result yet."""
    done = results.where("status = 'success'").select("doc_id", "page").distinct()
    return pages.join(done, ["doc_id", "page"], "left_anti")


def furniture(pages: DataFrame, first: int = 5, least: int = 5, on_pages: int = 2) -> DataFrame:
    """Offline header detection: trimmed lines of at least ``least`` characters of a document's first pages that
    stand on at least ``on_pages`` of its pages, as (doc_id, fragment, pages).

    The lines are counted by equality; nothing is compared with every page.
    """
    lines = pages.where("status = 'success'").select("doc_id", "page", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.withColumn("line", trim_u(F.col("line"))).where(F.length("line") >= least)
    per = lines.groupBy("doc_id", "line").agg(F.count_distinct("page").alias("pages"), F.min("page").alias("at"))
    firsts = pages.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_set("page")), 1, first).alias("firsts"))
    return per.where(F.col("pages") >= on_pages).join(firsts, "doc_id").where(F.array_contains("firsts", F.col("at"))).select("doc_id", F.col("line").alias("fragment"), "pages")


def verified(candidates: DataFrame, pages: DataFrame, least: int = 5, on_pages: int = 2) -> DataFrame:
    """Of proposed fragments (doc_id, fragment) those that at least ``on_pages`` pages of the document contain."""
    c = candidates.withColumn("fragment", trim_u(F.col("fragment"))).where(F.length("fragment") >= least).distinct()
    both = c.join(pages.where("status = 'success'"), "doc_id").where(F.contains("text", F.col("fragment")))
    return both.groupBy("doc_id", "fragment").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= on_pages)


def without_furniture(pages: DataFrame, fragments: DataFrame) -> DataFrame:
    """Pages with the document's fragments (longest first) taken out and white space tidied; documents of fewer than
    two successful pages, or without fragments, pass unchanged."""
    lists = fragments.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.length("fragment")).alias("n"), "fragment"))), lambda x: x["fragment"]).alias("fragments"))
    n = pages.groupBy("doc_id").agg(F.count_if(F.col("status") == "success").alias("good"))
    rows = pages.join(lists, "doc_id", "left").join(n, "doc_id")
    cut = F.aggregate("fragments", F.col("text"), lambda t, f: F.replace(t, f, F.lit("")))
    change = (F.col("good") >= 2) & F.col("fragments").isNotNull() & (F.col("status") == "success")
    return rows.withColumn("clean", F.when(change, cleanup_breaks(cut)).otherwise(F.col("text"))).drop("fragments", "good")


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    before, after = F.sum(F.octet_length("text")), F.sum(F.octet_length("clean"))
    return cleaned.groupBy("doc_id").agg((before - after).alias("removed"), F.count_if(F.col("text") != F.col("clean")).alias("pages_cleaned"), F.round((before - after) / before, 6).alias("efficiency"))


def combine(pages: DataFrame, text: str = "text", glue: str = "\n", end: str = "\n") -> DataFrame:
    """One text per document: non-blank pages in order, each trimmed and ended by ``end``, joined by ``glue``."""
    body = trim_u(F.col(text))
    rows = pages.select("doc_id", "page", body.alias("t")).where("t <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: F.concat(x["t"], F.lit(end)))
    return rows.groupBy("doc_id").agg(F.array_join(ordered, glue).alias("text"))


def statistics(pages: DataFrame) -> DataFrame:
    n, good = F.count(F.lit(1)), F.count_if(F.col("status") == "success")
    size = F.when(F.col("status") == "success", F.length("text"))
    return pages.groupBy("doc_id").agg(
        n.alias("pages"), good.alias("successful"), (n - good).alias("failed"), F.round(good / n, 6).alias("success_rate"), F.count_if(has_table(F.col("text"))).alias("with_tables"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_length"), F.coalesce(F.floor(F.avg(size)), F.lit(0)).cast("long").alias("mean_length")
    )


def all_results(*parts: DataFrame) -> DataFrame:
    """Results of several batches and of success and failure lists, as one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def is_rate_limit(error: Column) -> Column:
    return F.lower(error).rlike(RATE_LIMIT.pattern)
