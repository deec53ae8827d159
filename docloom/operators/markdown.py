"""Markdown to plain text: tables become ``column: value`` rows, marks go, blank lines go."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import is_table_line, plain_line, table_cells, trim_u


def to_plain(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents of Markdown.

    Of a run of table lines the first names the columns, the second is the separator, and each further line becomes one
    row.  The line after a table is only trimmed.  A text of blank lines gives the empty text.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = lines.withColumn("t", is_table_line(F.col("line"))).withColumn("before", F.lag("t", 1, False).over(w))
    rows = rows.withColumn("run", F.sum((F.col("t") & ~F.col("before")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("doc_id", "run", "t").orderBy("n")
    rows = rows.withColumns({"k": F.row_number().over(within), "head": F.first("line").over(within)})
    head, cells = table_cells(F.col("head")), table_cells(F.col("line"))
    n = F.least(F.size(head), F.size(cells))
    pairs = F.array_join(F.zip_with(F.slice(head, F.lit(1), n), F.slice(cells, F.lit(1), n), lambda a, b: F.concat(a, F.lit(": "), b)), "; ")
    out = F.when(F.col("t"), F.when(F.col("k") > 2, pairs)).when(F.col("before"), trim_u(F.col("line"))).otherwise(plain_line(F.col("line")))
    rows = rows.select("doc_id", "n", out.alias("o"))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("n", "o"))), lambda x: trim_u(x["o"]) != "")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(kept, lambda x: x["o"]), "\n").alias("text"))
