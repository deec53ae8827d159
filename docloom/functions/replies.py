"""Parsing of model replies: JSON that may sit in Markdown fences or in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import trim_u

ENTITY = "struct<name:string,type:string,description:string,confidence:string,aliases:array<string>,evidence:string>"
REPLY = f"struct<entities:array<{ENTITY}>,relationships:array<struct<source:string,target:string,type:string,evidence:string>>>"


def _json(c: Column) -> Column:
    """The text if it is JSON, else null."""
    return F.when(F.try_parse_json(c).isNotNull() & c.rlike(r"^\s*[\[{]"), c)


def json_fence(c: Column) -> Column:
    return F.nullif(trim_u(F.regexp_extract(c, r"(?s)```json\s*(.*?)```", 1)), F.lit(""))


def any_fence(c: Column) -> Column:
    return F.nullif(trim_u(F.regexp_extract(c, r"(?s)```[a-zA-Z]*\s*(.*?)```", 1)), F.lit(""))


def robust_json(c: Column) -> Column:
    """The whole reply, a ``json`` block, any block, or the widest braces: the first that is JSON, else null."""
    braces = F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.coalesce(_json(trim_u(c)), _json(json_fence(c)), _json(any_fence(c)), _json(braces))


def simple_json(c: Column, required: str | None = None) -> Column:
    """For short replies: fences off, breaks and tabs to spaces; null without a brace or the required key."""
    s = trim_u(F.regexp_replace(F.regexp_replace(c, "```(json)?", ""), r"[\n\r\t]", " "))
    s = F.when(c.contains("{"), _json(s))
    return F.when(F.get_json_object(s, f"$.{required}").isNotNull(), s) if required else s


def entity_reply(c: Column) -> Column:
    """Entities and relationships of a reply: an object with both, or a bare list of entities; empty lists on failure."""
    s = unfenced(c)
    return entity_json(F.when(F.try_parse_json(s).isNotNull(), s))


def unfenced(c: Column) -> Column:
    """A reply without its fence and white space at both ends."""
    return F.coalesce(json_fence(c), any_fence(c), trim_u(c))


def entity_json(s: Column) -> Column:
    """The same of what is JSON or null."""
    whole = F.from_json(s, REPLY)
    bare = F.from_json(s, f"array<{ENTITY}>")
    is_list = s.startswith("[")
    none = F.from_json(F.lit("[]"), f"array<{ENTITY}>")
    return F.struct(
        F.coalesce(F.when(is_list, bare).otherwise(whole["entities"]), none).alias("entities"),
        F.coalesce(F.when(~is_list, whole["relationships"]), F.from_json(F.lit("[]"), "array<struct<source:string,target:string,type:string,evidence:string>>")).alias("relationships"),
    )
