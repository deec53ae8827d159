"""Documents from files: routing, decoding, rejection with a reason, and optional binary formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, cleanup_text, trim_u

EXTENSIONS = (".docx", ".md", ".pdf", ".rtf", ".txt")
MOST_BYTES = 50 << 20
SCHEMA = "source_file string, file_type string, content string, metadata map<string,string>, error string"


def route(path: Column) -> Column:
    """text, pdf or unsupported, by extension."""
    p = F.lower(path)
    return F.when(p.rlike(r"\.(md|txt)$"), F.lit("text")).when(p.endswith(".pdf"), F.lit("pdf")).otherwise(F.lit("unsupported"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*EXTENSIONS)


def valid_text(text: Column) -> Column:
    """Not blank and at most 50 MiB of UTF-8 once trimmed."""
    return F.octet_length(trim_u(text)).between(1, MOST_BYTES)


def decoded(content: Column) -> Column:
    """UTF-8 (a byte-order mark dropped) where the bytes are that, else ISO-8859-1."""
    good = F.is_valid_utf8(content.cast("string"))
    utf8 = F.regexp_replace(content.cast("string"), "^\\x{FEFF}", "")
    return F.when(good, utf8).otherwise(F.decode(content, "ISO-8859-1"))


Parser = Callable[[bytes], tuple[str, dict[str, str]]]


def _pdf(data: bytes) -> tuple[str, dict[str, str]]:
    """Page texts, blank pages left out; an encrypted file is refused."""
    from docloom.sources.pages import read_pages

    pages = [str(p["text"]) for p in read_pages(data)]
    full = [p for p in pages if p.strip()]
    return "\n\n".join(full), {"page_count": str(len(pages)), "pages_with_text": str(len(full))}


def _docx(data: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs of the main part; the format is a ZIP of XML, so nothing beyond the standard library is needed."""
    import io
    import zipfile
    from xml.etree import ElementTree

    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    every = ["".join(t.text or "" for t in p.iter(f"{ns}t")) for p in root.iter(f"{ns}p")]
    full = [p for p in every if p.strip()]
    return "\n\n".join(full), {"paragraph_count": str(len(full)), "total_paragraphs": str(len(every))}


def _rtf(data: bytes) -> tuple[str, dict[str, str]]:
    """The plain text of an RTF file: groups that hold no text skipped, escapes resolved."""
    import re

    src = data.decode("latin-1")
    out, stack, skip, i = [], [], False, 0
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "generator", "header", "footer"}
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", src, re.I | re.S):
        word, num, code, sign, brace, char = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif word in hidden or sign == "*":
            skip = True
        elif skip:
            continue
        elif word in ("par", "line"):
            out.append("\n")
        elif word == "tab":
            out.append("\t")
        elif word == "u" and num:
            out.append(chr(int(num) % 65536))
            i = 1
            continue
        elif code:
            out.append(bytes.fromhex(code).decode("cp1252", "replace"))
        elif sign in ("{", "}", "\\"):
            out.append(sign)
        elif char and not i:
            out.append(char)
        i = 0
    text = "".join(out)
    return text, {"rtf_size": str(len(data)), "text_size": str(len(text))}


PARSERS: dict[str, Parser] = {".pdf": _pdf, ".docx": _docx, ".rtf": _rtf}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, ext, data in zip(b["path"], b["ext"], b["content"]):
            try:
                text, meta = PARSERS[ext](bytes(data))
                rows.append((path, ext[1:], text, meta, None))
            except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failed task
                rows.append((path, ext[1:], None, {}, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["source_file", "file_type", "content", "metadata", "error"])


def read_files(spark: SparkSession, path: str, pattern: str = "*", most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of the files under ``path``.

    A file is rejected for its size, its extension, an error in parsing, or blank text; the reason is its ``error``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("ext", extension(F.col("path")))
    # the size is a filter of its own, which the scan applies before it opens a file; what is refused is never read
    why = F.when(F.col("length") > most_bytes, F.lit("too large")).when(~F.col("ext").isin(*EXTENSIONS), F.lit("unsupported extension"))
    refused = files.where((F.col("length") > most_bytes) | ~F.col("ext").isin(*EXTENSIONS)).withColumn("why", why).select(F.col("path").alias("source_file"), F.substring("ext", 2, 10).alias("file_type"), F.lit(None).cast("string").alias("content"), F.create_map().cast("map<string,string>").alias("metadata"), F.col("why").alias("error"))
    files = files.where(F.col("length") <= most_bytes).select("path", "ext", "content")
    plain = files.where(F.col("ext").isin(".md", ".txt"))
    text = decoded(F.col("content"))
    read = plain.select(F.col("path").alias("source_file"), F.substring("ext", 2, 10).alias("file_type"), text.alias("content"), F.create_map(F.lit("line_count"), F.size(F.split(text, "\n")).cast("string"), F.lit("char_count"), F.length(text).cast("string")).alias("metadata"), F.lit(None).cast("string").alias("error"))
    other = files.where(F.col("ext").isin(*PARSERS)).mapInPandas(_parse, SCHEMA)
    every = read.unionByName(other).withColumn("content", cleanup_text(F.col("content")))
    every = every.withColumn("error", F.when(F.col("error").isNull() & ~F.coalesce(valid_text(F.col("content")), F.lit(False)), F.lit("blank or too large")).otherwise(F.col("error")))
    return every.where("error is null").drop("error"), every.where("error is not null").unionByName(refused).select("source_file", "file_type", "error")


def load_status(documents: DataFrame, errors: DataFrame) -> DataFrame:
    return documents.select(F.lit("success").alias("status")).union(errors.select(F.lit("failed"))).groupBy("status").count()


def from_texts(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """Documents from (name, text) pairs held by the caller."""
    return spark.createDataFrame(texts, "source_file string, content string").select("source_file", F.lit("text").alias("file_type"), cleanup_text(F.col("content")).alias("content"), F.create_map().cast("map<string,string>").alias("metadata"))


__all__ = ["SPACE", "read_files", "load_status", "from_texts", "route", "is_supported", "valid_text", "decoded"]
