"""Entities: mentions from an extractor, validated, thresholded, counted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.replies import entity_json, unfenced
from docloom.functions.text import around, trim_u
from docloom.operators.chunking import settle
from docloom.operators.domains import DOMAINS, threshold
from docloom.operators.providers import Extractor, Provider, RuleExtractor

GATE, VALID = 0.2, 0.3


def mentions(chunks: DataFrame, extractor: Extractor | None = None, text: str = "text") -> DataFrame:
    """One row per raw entity of every chunk: the extractor's fields beside the chunk's other columns."""
    found = (extractor or RuleExtractor()).extract(F.col(text))
    rows = chunks.select(*[c for c in chunks.columns if c != text], F.posexplode(found).alias("ord", "e"))
    return rows.select(*[c for c in rows.columns if c != "e"], "e.*")


def from_replies(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Raw entities of model replies; a reply that isn't JSON gives none.  Each step is done once per reply."""
    rows = settle(replies, __said=unfenced(F.col(reply)))
    rows = settle(rows, __json=F.when(F.try_parse_json("__said").isNotNull(), F.col("__said")))
    rows = settle(rows, __entities=entity_json(F.col("__json"))["entities"])
    rows = rows.select(*[c for c in replies.columns if c != reply], F.posexplode("__entities").alias("ord", "e"))
    return rows.select(*[c for c in rows.columns if c != "e"], "e.*")


def ask(chunks: DataFrame, provider: Provider, domain: str, known: Column | None = None) -> DataFrame:
    """Model replies for each chunk: (…, prompt, reply, error).  Write the result before using it twice."""
    prompt = DOMAINS[domain].prompt(F.col("text"), known)
    rows = chunks.withColumn("prompt", prompt).withColumn("answer", provider.column(F.col("prompt")))
    return rows.select(*chunks.columns, "prompt", "answer.reply", "answer.error")


def fan_out(chunks: DataFrame, domains: Column) -> DataFrame:
    """A row for each chunk and domain; an array column of names per chunk."""
    return chunks.withColumn("domain", F.explode(domains))


def clean_aliases(aliases: Column, name: Column) -> Column:
    """Trimmed, without blanks, without the name in any case; repeats after the first dropped."""
    a = F.filter(F.transform(aliases, trim_u), lambda x: (x != "") & (F.lower(x) != F.lower(name)))
    return F.coalesce(F.array_distinct(a), F.array().cast("array<string>"))


def validate(raw: DataFrame, types: list[str] | None = None, thresholds: dict[str, float] | None = None, hook: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """Raw entities made clean, others dropped.

    Name and type trimmed (type in upper case) and not empty; 2 to 100 characters of name; a type of the domain, if
    there is one; the hook's predicate; confidence as a number within 0 and 1 (0.5 if missing or none), at least the
    type's threshold (without a domain a tenth less, but 0.15 at least).  A row with a bad field is dropped alone.
    """
    rows = raw.withColumns({"name": trim_u(F.col("name")), "type": F.upper(trim_u(F.col("type")))})
    rows = rows.where(F.length("name").between(2, 100) & (F.col("type") != ""))
    if types is not None:
        rows = rows.where(F.col("type").isin(*types))
    if hook is not None:
        rows = rows.where(hook(rows))
    given = F.expr("try_cast(confidence AS double)")
    confidence = F.coalesce(F.when(~F.isnan(given), given), F.lit(0.5))
    limit = threshold(F.col("type"), thresholds)
    limit = limit if types is not None else F.greatest(F.lit(0.15), F.round(limit - 0.1, 9))
    rows = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).where(F.col("confidence") >= limit)
    return rows.withColumns({"description": trim_u(F.coalesce("description", F.lit(""))), "aliases": clean_aliases(F.col("aliases"), F.col("name")), "evidence": F.coalesce("evidence", F.lit(""))})


def second_gate(entities: DataFrame) -> DataFrame:
    return entities.where((F.col("confidence") >= GATE) & (F.length(trim_u(F.col("name"))) >= 2) & (F.col("type") != ""))


def with_context(entities: DataFrame, chunks: DataFrame, on: list[str], reach: int = 100) -> DataFrame:
    """Each entity with the text around its first mention in its chunk."""
    rows = entities.join(chunks.select(*on, F.col("text").alias("__text")), on)
    return rows.withColumn("context", around(F.col("__text"), F.col("name"), reach)).drop("__text")


def entity_id(*parts: str) -> Column:
    """An id from content, so that a retried task gives it again."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def resolve_relations(relations: DataFrame, entities: DataFrame, on: list[str]) -> DataFrame:
    """Relations by name within a chunk become edges between entity ids; names that no entity has are dropped."""
    e = entities.groupBy(*on, F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    a, b = e.withColumnsRenamed({"key": "s", "id": "source_id"}), e.withColumnsRenamed({"key": "t", "id": "target_id"})
    r = relations.withColumns({"s": F.lower(trim_u(F.col("source"))), "t": F.lower(trim_u(F.col("target")))})
    return r.join(a, [*on, "s"]).join(b, [*on, "t"]).select(*on, "source_id", "target_id", F.upper("type").alias("relation_type"), "evidence")


def by_domain(chunks: DataFrame, domains: Column, extractor: Extractor | None = None) -> DataFrame:
    """Every chunk's entities for each of its domains: raw entities found once, kept by the domain's own types and
    thresholds, tagged with the domain; the same entity of two domains stays twice.

    Domains that don't exist are passed over.
    """
    table = chunks.sparkSession.createDataFrame([(d.name, t) for d in DOMAINS.values() for t in d.types], "domain string, __type string")
    raw = fan_out(mentions(chunks.withColumn("__domains", domains), extractor), F.col("__domains")).drop("__domains")
    own = raw.join(F.broadcast(table), (raw["domain"] == table["domain"]) & (F.upper(trim_u(raw["type"])) == table["__type"]), "left_semi")
    return second_gate(validate(own, sorted({t for d in DOMAINS.values() for t in d.types})))


def stored_rows(entities: DataFrame, chunks: DataFrame, on: list[str], source: Column, now: Column) -> DataFrame:
    """Entities as the store keeps them: an id, the chunk and the document they come from, and times."""
    c = chunks.select(*on, F.col("id").alias("source_chunk_id"), source.alias("document_source"))
    rows = entities.join(c, on)
    return rows.withColumns({"id": entity_id("source_chunk_id", "ord", "name", "type"), "source_chunk_ids": F.array("source_chunk_id"), "created_at": now, "updated_at": now})


def known_lines(context: DataFrame, by: str, most: int = 8, aliases: int = 3) -> DataFrame:
    """(by, known): for each chunk the lines about its best entities (score, name, type, aliases), best first, each with up to
    ``aliases`` other names and its likeness as a relation."""
    line = F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit(")"), F.when(F.size("aliases") > 0, F.concat(F.lit(" = "), F.array_join(F.slice("aliases", 1, aliases), ", "))).otherwise(F.lit("")), F.lit(" SIMILAR_CONTEXT "), F.format_number("score", 3))
    rows = context.where(F.col("rank") <= most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("all"))
    return rows.select(by, F.transform("all", lambda x: x["line"]).alias("known"))


def merge_aliases(existing: Column, new: Column, name: Column) -> Column:
    """``existing`` with the new aliases that are neither blank, nor the name, nor there already in any case."""
    step = lambda acc, x: F.when((x == "") | (F.lower(x) == F.lower(name)) | F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x))
    return F.aggregate(F.transform(new, trim_u), existing, step)


def stats(raw: DataFrame, valid: DataFrame, by: str = "domain") -> DataFrame:
    """Raw, valid and rejected entities per domain, computed from the rows themselves (retries can't count twice)."""
    a = raw.groupBy(by).agg(F.count(F.lit(1)).alias("raw"))
    b = valid.groupBy(by).agg(F.count_if(F.col("confidence") >= VALID).alias("valid"))
    valid_n = F.coalesce("valid", F.lit(0))
    return a.join(b, by, "left").select(by, "raw", valid_n.cast("long").alias("valid"), (F.col("raw") - valid_n).cast("long").alias("rejected"))
