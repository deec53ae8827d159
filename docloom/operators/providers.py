"""Providers: what calls a model sits behind these, and each has a reproducible offline form made of columns.

A provider maps columns to a column.  A hosted model would be an Arrow function marked non-deterministic whose result
is written before use; the offline forms are plain expressions, or Arrow functions with the
same results, so queries on them can be checked with SQL.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from docloom.functions.vectors import rounded_np


#: What a service says when it has been called too often; anything else isn't tried again.
RATE_LIMIT = re.compile(r"rate.?limit|429|too many requests|rate_limit_exceeded", re.IGNORECASE)


class Embedder(Protocol):
    model: str

    def embed(self, text: Column) -> Column: ...


class Extractor(Protocol):
    def extract(self, text: Column) -> Column:
        """An array of struct<name, type, description, confidence, aliases, evidence>."""


class Classifier(Protocol):
    def domains(self, row: DataFrame) -> Column: ...


class Sectioner(Protocol):
    def starts(self, text: Column) -> Column: ...


def _letters() -> Callable[[pa.Array], pa.Array]:
    """What makes letter vectors of an array of texts; a local function, which travels to workers by value."""
    piece = 1 << 20  # bytes of text counted at once
    wide = {"\u0130".encode(): 8, "\u212a".encode(): 10}  # the two letters beyond ASCII whose lower case is one of a to z

    def counts(texts: pa.Array) -> np.ndarray:
        texts = texts.cast(pa.large_string())
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out = np.zeros((len(texts), 26))
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + piece, "right")) - 1)
            own = data[at[first] : at[last]]
            code, text = (own | 32) - 97, np.repeat(np.arange(last - first), np.diff(at[first : last + 1]))
            ok = code < 26  # of a byte that is no letter the difference wraps round
            out[first:last] += np.bincount(text[ok] * 26 + code[ok], minlength=26 * (last - first)).reshape(-1, 26)
            raw = own.tobytes()
            for form, letter in wide.items():
                where = raw.find(form)
                while where >= 0:
                    out[first + text[where], letter] += 1
                    where = raw.find(form, where + 1)
            first = last
        return out

    def run(texts: pa.Array) -> pa.Array:
        n = counts(texts)
        norm = np.sqrt((n * n).sum(1, keepdims=True))
        v = rounded_np(np.divide(n, norm, out=np.zeros_like(n), where=norm > 0))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 26), pa.array(v.ravel()))

    return run


_vectors = _letters()


@F.arrow_udf(ArrayType(DoubleType()))
def _letter_vector(texts: pa.Array) -> pa.Array:
    return _vectors(texts)


@F.arrow_udf(ArrayType(ArrayType(DoubleType())))
def _letter_vectors(rows: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(rows), 0)  # no vectors where there is no array
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))].astype(np.int32)), _vectors(rows.flatten()))


@dataclass
class LetterEmbedder:
    model: str = "letters-26"

    def embed(self, text: Column) -> Column:
        """Letter frequencies as a unit vector, by Arrow; zeros for text without letters."""
        return _letter_vector(text)

    def embed_all(self, texts: Column) -> Column:
        """The same for an array of texts, in one Arrow call for a whole batch of rows."""
        return _letter_vectors(texts)


def _entity(name: Column, kind: str, confidence: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), none.alias("description"), confidence.cast("string").alias("confidence"), F.array().cast("array<string>").alias("aliases"), none.alias("evidence"))


@dataclass
class RuleExtractor:
    """Capitalised words, addresses and numbers; confidence grows with the length of the name."""

    rules: dict[str, str] = field(
        default_factory=lambda: {
            "CHARACTER": r"([A-Z][a-z]{3,})",
            "ADDRESS": r"([A-Za-z0-9._+-]+@[A-Za-z0-9.-]+)",
            "DATE": r"([0-9]{2,})",
        }
    )

    @staticmethod
    def _of(kind: str) -> Callable[[Column], Column]:
        return lambda x: _entity(x, kind, F.round(F.least(F.lit(1.0), F.length(x) / 10.0), 3))

    def extract(self, text: Column) -> Column:
        out = []
        for kind, pattern in self.rules.items():
            found = F.regexp_extract_all(text, F.lit(pattern), 1)
            out.append(F.transform(found, self._of(kind)))
        return F.concat(*out)


@dataclass
class RuleClassifier:
    """Domains by language and source."""

    def domains(self, lang: Column, source: Column) -> Column:
        first = F.when(lang == "en", F.lit("literary")).when(lang == "de", F.lit("financial")).when(lang == "fr", F.lit("owu")).otherwise(F.lit("simple"))
        return F.when(source == "src0", F.array(first, F.lit("simple"))).otherwise(F.array(first))


@dataclass
class LineSectioner:
    """The first ``size`` characters of every ``every``-th line."""

    every: int = 3
    size: int = 20

    def starts(self, text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x, i: (i % self.every == 0) & (F.length(x) > 0))
        return F.transform(lines, lambda x: F.substring(x, 1, self.size))


@dataclass
class Provider:
    """An outside model by name, with what a call needs; registered by the application, never imported here."""

    name: str
    call: Callable[[list[str]], list[str]]
    batch: int = 10
    retries: int = 1
    backoff: float = 30.0  # seconds before a call that the service's rate limit refused is made again
    calls_at_once: int | None = None

    def bounded(self, rows: DataFrame) -> DataFrame:
        """``rows`` in as many partitions as calls may run at once: each task makes one call at a time."""
        return rows if self.calls_at_once is None else rows.repartition(self.calls_at_once)

    def column(self, prompt: Column) -> Column:
        """Replies as a struct (reply, error): failures become rows, never failed tasks."""
        call, batch, retries, backoff = self.call, self.batch, self.retries, self.backoff

        @F.pandas_udf("reply string, error string")
        def ask(prompts: pd.Series) -> pd.DataFrame:
            out: list[tuple[str | None, str | None]] = []
            items = list(prompts)
            for a in range(0, len(items), batch):
                part = items[a : a + batch]
                for left in range(retries, -1, -1):
                    try:
                        out += [(r, None) for r in call(part)]
                        break
                    except Exception as e:  # noqa: BLE001 - the error is the row's result
                        if left and RATE_LIMIT.search(str(e)):
                            time.sleep(backoff)
                        else:
                            out += [(None, f"{type(e).__name__}: {e}")] * len(part)
                            break
            return pd.DataFrame(out, columns=["reply", "error"])

        return ask.asNondeterministic()(prompt)


#: Limits by model: (context, output); an unknown model has the fallback.
LIMITS: dict[str, tuple[int, int]] = {"offline-1m": (1_000_000, 32_768), "offline-200k": (200_000, 16_384), "offline-128k": (128_000, 16_384), "offline-32k": (32_768, 8_192)}
FALLBACK = (32_768, 8_192)


def context_limit(model: str) -> int:
    return LIMITS.get(model, FALLBACK)[0]


def output_limit(model: str) -> int:
    return LIMITS.get(model, FALLBACK)[1]


def checked(config: dict[str, object], required: tuple[str, ...] = ("model", "vision_prompt")) -> dict[str, object]:
    """The config if its required values are there and not blank."""
    bad = [k for k in required if not str(config.get(k) or "").strip()]
    if bad:
        raise ValueError(f"missing or blank in the config: {', '.join(bad)}")
    return config
