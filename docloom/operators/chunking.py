"""Chunkers: documents (doc_id, text, ...) in, one row per chunk out.

All of them are narrow: a document is cut by expressions on its own row, so no text is shuffled.  Offsets are code
points, 0-based, ends exclusive.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from docloom.functions.text import preview, trim_u
from docloom.functions.vectors import rounded, similarity
from docloom.operators.domains import DOMAINS, Domain, percentile_of
from docloom.operators.providers import Embedder, LetterEmbedder, LineSectioner, Sectioner, context_limit

LEAST, MOST, CUT = 100, 10_000, 500


def settle(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    The optimiser may merge a projection into the expressions above it, also into the body of a lambda, where it would
    be computed once per element.  A generator of one row stands in the way of that.
    """
    packed = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("__settled")
    return df.select("*", packed).select(*df.columns, *(F.col(f"__settled.{k}").alias(k) for k in columns))


def prompt_overhead(domains: list[Domain] | None = None) -> int:
    """Tokens a prompt needs besides the text: 1500 without domains, else the longest prompt's words and some."""
    if not domains:
        return 1500
    return max(int(len((d.meta + d.extraction).split()) * 1.33) for d in domains) + 300


def chunk_size(model: str, domains: list[Domain] | None = None) -> int:
    return int((context_limit(model) - prompt_overhead(domains)) * 0.75)


def _smart_end(window: Column, half: int) -> Column:
    """How much of a window stays: up to the last paragraph, sentence or word break within reach of its end and past the
    chunk's middle."""
    n = F.length(window)
    lo = F.greatest(n - 200, F.lit(half))
    r = F.substr(window, lo + 1, n - lo)
    last_space = F.instr(F.reverse(r), " ")
    word = F.when(last_space > 0, lo + F.length(r) - last_space + 1)
    sentence = F.length(F.regexp_extract(r, r"(?s)^(.*[.!?]\n)", 1))
    paragraph = F.length(F.regexp_extract(r, r"(?s)^((?:.*?\n\n)+)", 1))
    best = F.greatest(word, F.when(sentence > 0, lo + sentence), F.when(paragraph > 0, lo + paragraph))
    return F.when((n > lo) & (best > half), best).otherwise(n)


def model_aware(docs: DataFrame, size: int, overlap: int = 400, most: int | None = None, smart: bool = True) -> DataFrame:
    """Windows of ``size`` characters at a stride of size - overlap, all or the first ``most``, ends pulled to a break.

    Starts don't depend on moved ends.  A document without text has no chunk.  The text is cut once into pieces of a
    stride each, of which a window takes the few it needs, so the work is linear in the text.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap must be smaller than the size")
    others = [c for c in docs.columns if c != "text"]
    rows = settle(docs.where(F.length("text") > 0), n=F.length("text"), pieces=F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), 0)).drop("text")
    count = F.lit(1) + F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / step).cast("int")
    count = count if most is None else F.least(F.lit(most), count)
    window = lambda i: F.substr(F.array_join(F.slice("pieces", i + 1, F.lit(-(-size // step))), ""), F.lit(1), F.lit(size))
    rows = rows.select(*others, "n", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), window)).alias("chunk_id", "window"))
    rows = rows.withColumn("start", F.col("chunk_id") * step)
    inner = F.col("start") + F.length("window") < F.col("n")
    keep = F.when(inner, _smart_end(F.col("window"), size // 2)).otherwise(F.length("window")) if smart else F.length("window")
    rows = settle(rows, kept=keep)
    end = (F.col("start") + F.col("kept")).cast("int")
    return rows.select(*others, "chunk_id", "start", end.alias("end"), F.substr("window", F.lit(1), F.col("kept")).alias("text"), (F.col("chunk_id") > 0).alias("overlap_start"), (end < F.col("n")).alias("overlap_end"))


@F.pandas_udf(ArrayType(IntegerType()))
def _before(sizes: pd.Series) -> pd.Series:
    """For each of a row's sizes the sum of those before it; only sizes travel."""
    return pd.Series([np.r_[0, np.cumsum(x)][:-1].astype(np.int32) if x is not None and len(x) else np.zeros(0, np.int32) for x in sizes])


def by_lines(docs: DataFrame, per: int = 10) -> DataFrame:
    """Every ``per`` lines are a chunk; joined by line breaks they give the text again."""
    lines = settle(docs, lines=F.split("text", "\n"))
    count = F.ceil(F.size("lines") / per).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice("lines", i * per + 1, F.lit(per)), "\n"))
    others = [c for c in docs.columns if c != "text"]
    rows = settle(lines, chunks=chunks).select(*others, "chunks")
    rows = rows.withColumn("starts", _before(F.transform("chunks", lambda c: F.length(c) + 1)))
    rows = rows.select(*others, F.posexplode(F.arrays_zip("chunks", "starts")).alias("chunk_id", "c"))
    return rows.select(*others, "chunk_id", F.col("c.starts").alias("start"), (F.col("c.starts") + F.length("c.chunks")).alias("end"), F.col("c.chunks").alias("text"))


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Dense chunk ids over an array of (start, end, text) that is never empty."""
    return rows.select(*columns, F.posexplode("parts").alias("chunk_id", "part")).select(*columns, "chunk_id", "part.start", "part.end", "part.text")


def _whole(text: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), text.alias("text")))


def by_sections(docs: DataFrame, sectioner: Sectioner | None = None, least: int = LEAST) -> DataFrame:
    """From each section's first words to the next section's; short ones are dropped, and what stands before the first.

    Nothing found, or nothing left, gives the whole text as one chunk.
    """
    starts = (sectioner or LineSectioner()).starts(F.col("text"))
    at = F.transform(F.filter(starts, lambda s: s != ""), lambda s: F.instr(F.col("text"), s) - 1)
    at = F.array_sort(F.array_distinct(F.filter(at, lambda p: p >= 0)))
    rows = settle(docs, at=at)
    end = F.concat(F.slice("at", 2, 1 << 30), F.array(F.length("text")))
    part = F.zip_with("at", end, lambda a, e: F.struct(a.alias("start"), e.alias("end"), trim_u(F.substr("text", a + 1, e - a)).alias("text")))
    kept = F.filter(part, lambda p: F.length(p["text"]) >= least)
    rows = settle(rows, parts=kept)
    rows = rows.withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")).otherwise(_whole(F.col("text"))))
    return _numbered(rows, [c for c in docs.columns if c != "text"])


def sentences(text: Column) -> Column:
    """The text at ``". "``, trimmed and without blanks; a full stop ends the last; 500 characters at most."""
    return _ended(F.filter(F.transform(F.split(text, r"\. "), trim_u), lambda s: s != ""))


def _ended(raw: Column) -> Column:
    n = F.size(raw)
    dotted = F.transform(raw, lambda s, i: F.when((i == n - 1) & ~s.endswith("."), F.concat(s, F.lit("."))).otherwise(s))
    return F.transform(dotted, lambda s: F.when(F.length(s) > CUT, F.concat(F.substring(s, 1, CUT), F.lit("..."))).otherwise(s))


def with_distances(docs: DataFrame, percentile: float, embedder: Embedder | None = None) -> DataFrame:
    """Sentences of each document, distances of neighbours, their percentile (linear), and the sentences after which
    the distance exceeds it (all rounded to nine places in the way of SQL engines, so that they agree)."""
    rows = settle(docs, raw=F.filter(F.transform(F.split("text", r"\. "), trim_u), lambda s: s != ""))
    rows = settle(rows, sentences=_ended(F.col("raw"))).drop("raw")
    rows = rows.withColumn("vectors", LetterEmbedder().embed_all(F.col("sentences"))) if embedder is None else settle(rows, vectors=F.transform("sentences", embedder.embed))
    gaps = F.zip_with(F.slice("vectors", 1, F.greatest(F.size("vectors") - 1, F.lit(0))), F.slice("vectors", 2, 1 << 30), lambda a, b: rounded(1 - similarity(a, b)))
    rows = settle(rows, distances=gaps).drop("vectors")
    rows = settle(rows, ranked=F.array_sort("distances"))
    at = (F.size("ranked") - 1) * (percentile / 100)
    low = F.floor(at).cast("int")
    lower, upper = F.try_element_at("ranked", low + 1), F.coalesce(F.try_element_at("ranked", low + 2), F.try_element_at("ranked", low + 1))
    rows = settle(rows, threshold=F.when(F.size("ranked") > 0, rounded(lower * (1 - (at - low)) + upper * (at - low)))).drop("ranked")
    over = F.transform("distances", lambda d, i: F.when(d > F.col("threshold"), i + 1))
    return settle(rows, boundaries=F.filter(over, lambda b: b.isNotNull()))


@F.pandas_udf(ArrayType(IntegerType()))
def _accepted(sizes: pd.Series, boundaries: pd.Series, least: pd.Series) -> pd.Series:
    """0 and the boundaries that are accepted, from left to right: the sentences since the last one and those after it,
    joined by spaces, must have ``least`` characters each.  Only sizes travel."""
    out = []
    for size, some, need in zip(sizes, boundaries, least):
        total = np.r_[0, np.cumsum(size + 1)] if size is not None and len(size) else np.zeros(1, np.int64)  # each with a space after it
        cuts, end = [0], int(total[-1])
        for b in some if some is not None else ():
            if total[b] - total[cuts[-1]] - 1 >= need and end - total[b] - 1 >= need:
                cuts.append(int(b))
        out.append(cuts)
    return pd.Series(out)


def by_percentile(docs: DataFrame, percentile: float = 90, embedder: Embedder | None = None, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Chunks between sentences that are unlike: a boundary is accepted, from left to right, if both the text since the
    last one and the text after it have ``least`` characters; chunks of other than ``least`` to ``most`` are dropped.
    ``dropped`` counts these.  Chunk text is the sentences joined by spaces, so periods at cuts are lost."""
    rows = with_distances(docs, percentile, embedder)
    rows = rows.withColumn("cuts", _accepted(F.transform("sentences", F.length), F.col("boundaries"), F.lit(least)))
    total = F.size("sentences")
    ends = F.concat(F.slice("cuts", 2, 1 << 30), F.array(total))
    part = F.zip_with("cuts", ends, lambda a, b: F.struct(a.alias("a"), F.array_join(F.slice("sentences", a + 1, F.greatest(b - a, F.lit(0))), " ").alias("text")))
    placed = F.transform(part, lambda p: F.struct((F.instr("text", F.element_at("sentences", p["a"] + 1)) - 1).alias("start"), p["text"].alias("text")))
    made = F.transform(F.filter(placed, lambda p: F.length(p["text"]).between(least, most)), lambda p: F.struct(p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), p["text"].alias("text")))
    rows = settle(rows, parts=F.when(F.size("cuts") > 1, made).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>")))
    rows = rows.withColumn("dropped", F.when(F.size("cuts") > 1, F.size("cuts") - F.size("parts")).otherwise(F.lit(0)))
    rows = rows.withColumn("parts", F.when(F.size("parts") > 0, F.col("parts")).otherwise(_whole(F.col("text"))))
    return _numbered(rows, [*[c for c in docs.columns if c != "text"], "dropped"])


def word_windows(docs: DataFrame, size: int = 200, overlap: int = 50, most: int | None = None) -> DataFrame:
    """Windows of ``size`` words at a stride of size - overlap: all of them, or for the text of a page the first ``most``."""
    step = size - overlap
    others = [c for c in docs.columns if c != "text"]
    rows = settle(docs, words=F.filter(F.split("text", r"\s+"), lambda w: w != "")).where(F.size("words") > 0)
    count = F.ceil(F.size("words") / step).cast("int")
    count = count if most is None else F.least(F.lit(most), count)
    window = lambda i: F.array_join(F.slice("words", i * step + 1, F.lit(size)), " ")
    return rows.select(*others, F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), window)).alias("chunk_id", "text"))


STRATEGIES = {"percentile": by_percentile, "section": by_sections, "line": by_lines}


def chunk(docs: DataFrame, domains: list[str] | None = None, strategy: str | None = None, **settings: object) -> DataFrame:
    """Chunks by the first domain's strategy (or the one named), with its percentile."""
    first = DOMAINS.get((domains or [""])[0])
    name = strategy or (first.strategy if first else "percentile")
    if name == "percentile":
        settings.setdefault("percentile", percentile_of(domains or []))
    return STRATEGIES[name](docs, **settings)


def with_metadata(chunks: DataFrame, source: Column, strategy: str, model: str, target: int, overlap: int, domains: list[str]) -> DataFrame:
    return chunks.withColumns({"document_source": source, "chunking_strategy": F.lit(strategy), "model_used": F.lit(model), "chunk_size_target": F.lit(target), "overlap_size": F.lit(overlap), "text_length": F.length("text"), "domains": F.array(*map(F.lit, domains)).cast("array<string>")})


def stats(chunks: DataFrame) -> DataFrame:
    n = F.length("text")
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.sum(n).cast("long").alias("total"), F.round(F.avg(n), 6).alias("mean"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.count_if(F.col("overlap_start") | F.col("overlap_end")).cast("long").alias("overlapping"))


def overlaps(chunks: DataFrame) -> DataFrame:
    """The text a chunk shares with the next one; null if there is none, no row for the last."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    both = chunks.withColumn("next_start", F.lead("start").over(w)).where("next_start is not null")
    n = F.col("end") - F.col("next_start")
    return both.select("doc_id", "chunk_id", F.when(n > 0, F.substr("text", F.col("next_start") - F.col("start") + 1, n)).alias("overlap_text"))


def previews(chunks: DataFrame, n: int = 100) -> DataFrame:
    return chunks.select("doc_id", "chunk_id", preview(F.col("text"), n).alias("preview"))
