"""Text functions as column expressions, with Python's notion of white space (code points, not bytes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes for white space.
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_u(c: Column) -> Column:
    """Without white space at both ends; a pattern would be tried at every character between them."""
    return F.btrim(c, F.lit(_SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return trim_u(F.regexp_replace(c, f"[{SPACE}]+", " "))


def cleanup_text(c: Column) -> Column:
    """Every line squeezed, line breaks kept, the whole trimmed."""
    return trim_u(F.array_join(F.transform(F.split(c, "\n"), squeeze), "\n"))


def normalise(c: Column) -> Column:
    """Anything but letters, digits, underscore and white space becomes a space; squeezed, lower case."""
    return squeeze(F.lower(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{SPACE}]", " ")))


def preview(c: Column, n: int = 100) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def title_preview(c: Column, most: int = 100) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)


def edges_text(c: Column, whole: int = 500, part: int = 200) -> Column:
    """What is embedded for a chunk: short text trimmed, else its first and last ``part`` characters."""
    short = trim_u(c)
    both = F.concat(trim_u(F.substring(c, 1, part)), F.lit(" ... "), trim_u(F.substring(c, -part, part)))
    return F.when(F.length(short) <= whole, short).otherwise(both)


def doc_name(c: Column) -> Column:
    """A document's name as a path element."""
    s = F.regexp_replace(c, r'[<>:"/\\|?*\s]', "_")
    return F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")


def file_name(c: Column, most: int = 50, default: str = "section") -> Column:
    s = F.regexp_replace(doc_name(c), "^[._]+|[._]+$", "")
    s = F.substring(s, 1, most)
    return F.when(s == "", F.lit(default)).otherwise(s)


def clean_markdown(c: Column, least: int = 10, placeholder: str = "*[no content]*") -> Column:
    """A model's Markdown reply without its fence, lines trimmed at the right; very short replies become a placeholder."""
    s = F.regexp_replace(trim_u(c), r"^```[a-zA-Z]*[ \t]*\n?|\n?```$", "")
    s = trim_u(F.regexp_replace(s, r"[ \t]+(?=\n|$)", ""))
    return F.when(F.length(s) < least, F.lit(placeholder)).otherwise(s)


def cleanup_breaks(c: Column) -> Column:
    """Two and more blank lines become one; lines are trimmed at the right, the whole at both ends."""
    s = F.regexp_replace(c, r"\n\s*\n\s*\n+", "\n\n")
    return trim_u(F.regexp_replace(s, r"[ \t]+(?=\n|$)", ""))


def clean_page_text(c: Column) -> Column:
    """Text extracted from a page: single spaces, short dot runs, no blank lines, trimmed lines."""
    s = F.regexp_replace(c, r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]", " ")
    s = F.regexp_replace(F.regexp_replace(s, " +", " "), r"\.{3,}", "...")
    lines = F.filter(F.transform(F.split(s, "\n"), trim_u), lambda x: x != "")
    return F.array_join(lines, "\n")


def has_table(c: Column) -> Column:
    """At least four pipes."""
    return (F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))) >= 4


def plain_line(c: Column) -> Column:
    """One Markdown line without bold, italic, link, heading and code marks, trimmed."""
    s = F.regexp_replace(c, r"\*\*(.*?)\*\*", "$1")
    s = F.regexp_replace(s, r"\*(.*?)\*", "$1")
    s = F.regexp_replace(s, r"\[(.*?)\]\(.*?\)", "$1")
    return trim_u(F.regexp_replace(F.regexp_replace(s, r"^#+\s*", ""), r"`([^`]*)`", "$1"))


def is_table_line(c: Column) -> Column:
    return c.rlike(r"^\s*\|.*\|\s*$")


def table_cells(c: Column) -> Column:
    inner = F.regexp_replace(trim_u(c), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"\|"), trim_u)


def around(text: Column, name: Column, reach: int = 100) -> Column:
    """The text around the first occurrence of a name, whatever its case; empty without one."""
    at = F.instr(F.lower(text), F.lower(name))
    first = F.greatest(F.lit(1), at - reach)
    last = F.least(F.length(text), at + F.length(name) - 1 + reach)
    return F.when((at > 0) & (name != ""), trim_u(F.substr(text, first, last - first + 1))).otherwise(F.lit(""))


def page_mentions(lines: Column) -> Column:
    """Distinct numbers of one to four digits from 1 to 9999 that stand alone, sorted."""
    found = F.regexp_extract_all(lines, F.lit(r"(?<![0-9\p{L}_])([0-9]{1,4})(?![0-9\p{L}_])"), 1)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x >= 1)))


def mime_of(base64: Column) -> Column:
    """Image type by the first characters of its base64 form."""
    kinds = (("iVBORw0KGgo", "image/png"), ("/9j/", "image/jpeg"), ("R0lGOD", "image/gif"), ("UklGR", "image/webp"))
    out = F.lit("image/jpeg")
    for start, kind in reversed(kinds):
        out = F.when(base64.startswith(start), F.lit(kind)).otherwise(out)
    return out
