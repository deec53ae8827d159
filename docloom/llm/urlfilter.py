"""URL filters: host and path rules, then a list of URLs behind a blocked Bloom filter.

The filter's size is bounded by a parameter, so it may be broadcast whatever the list's length.  It lets through
every listed URL and a few others; an exact, salted hash join on the canonical URL removes those others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise

WORDS, LANES = 4, 8  # a block is 4 longs; a URL sets 8 bits of its block


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    h = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without ``www.`` in front and slashes at the end."""
    return F.concat(F.regexp_replace(host, "^www\\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], field: int) -> Column:
    """The longest rule (verdict, host, path) that fits: its name (field 0) or its verdict (field 1); null if none.

    A rule fits its host and the subdomains of it if the path starts with the rule's path.
    """
    out = []
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out.append(F.when(fits, F.lit((h + p, verdict)[field])))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


class BlockedBloom:
    """A blocked Bloom filter built by one partial and one final aggregation over the list.

    It is a table of at most ``max_bytes`` of blocks, whatever the list's length, and is probed in the JVM: by a broadcast
    join on the block's number and a test of its bits.
    """

    def __init__(self, keys: DataFrame, key: str, bits_per_key: int = 16, max_bytes: int = 16 << 20):
        keys = keys.where(F.col(key).isNotNull())
        self.blocks = max(1, min(max_bytes // (8 * WORDS), -(-keys.count() * bits_per_key // (64 * WORDS))))
        sets = [F.bit_or(m).alias(f"__w{w}") for w, m in enumerate(self._masks(F.col(key)))]
        self.frame = materialise(keys.groupBy(self._block(F.col(key)).alias("__block")).agg(*sets), "bloom")

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks))

    @staticmethod
    def _masks(key: Column) -> list[Column]:
        """The bits that a key sets, in each word of its block."""
        g = F.xxhash64(key, F.lit(1))
        word = lambda i: F.shiftrightunsigned(g, 8 * i).bitwiseAND(F.lit(WORDS - 1).cast("long"))
        bit = lambda i: F.shiftrightunsigned(g, 8 * i + 2).bitwiseAND(F.lit(63).cast("long")).cast("int")
        one = lambda w, i: F.when(word(i) == w, F.call_function("shiftleft", F.lit(1).cast("long"), bit(i))).otherwise(F.lit(0).cast("long"))
        return [reduce(lambda a, b: a.bitwiseOR(b), [one(w, i) for i in range(LANES)]) for w in range(WORDS)]

    def mark(self, df: DataFrame, key: Column, name: str = "__maybe") -> DataFrame:
        """``df`` with a boolean column: false for a key that isn't in the list or is null, true for all that are in it
        and for a few others."""
        rows = df.withColumn("__block", F.when(key.isNotNull(), self._block(key)))
        fits = reduce(lambda a, b: a & b, [F.col(f"__w{w}").bitwiseAND(m) == m for w, m in enumerate(self._masks(key))])
        return rows.join(F.broadcast(self.frame), "__block", "left").withColumn(name, F.coalesce(fits, F.lit(False))).drop("__block", *(f"__w{w}" for w in range(WORDS)))

    @property
    def table(self) -> np.ndarray:
        out, got = np.zeros((self.blocks, WORDS), np.uint64), self.frame.toArrow()
        for w in range(WORDS):
            out[got["__block"].to_numpy(), w] = got[f"__w{w}"].to_numpy().view(np.uint64)
        return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, url: str = "url", per_salt: int = 1 << 16, most_hot: int = 1000, max_bytes: int = 16 << 20) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A fitting rule decides; otherwise a page whose canonical URL is in ``listed`` (its column ``url``) is blocked and
    any other is allowed.  A null URL or one without ``://`` has an empty host and path, fits no rule and is allowed.
    Repeated rows stay; columns of ``pages`` named like the new ones are replaced.  An empty list blocks nothing; URLs of
    any length are judged whole.  A listed URL that more than ``per_salt`` rows share is spread at random over as many join
    keys as it takes: the counts come from an aggregation of the possible hits.  The ``most_hot`` commonest ones are treated
    so; any other is on less than one row in ``most_hot``.
    """
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in new]
    u = F.col(f"`{url}`")
    base = pages.select(*(F.col(f"`{c}`") for c in keep), host_of(u).alias("host"), path_of(u).alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, 0)).withColumn("__ruled", rule_of(F.col("host"), F.col("path"), rules, 1))
    base = base.withColumn("__key", canonical(F.col("host"), F.col("path")))
    lu = F.col("url")
    keys = listed.select(canonical(host_of(lu), path_of(lu)).alias("__key")).where("__key <> ''").distinct()
    bloom = BlockedBloom(keys, "__key", max_bytes=max_bytes)
    base = bloom.mark(base, F.when(F.col("__ruled").isNull(), F.col("__key")))
    cols = [*keep, "host", "path", "rule"]
    sure = base.where(~F.col("__maybe")).select(*(F.col(f"`{c}`") for c in cols), F.coalesce("__ruled", F.lit("allow")).alias("verdict"))
    maybe = base.where("__maybe")
    hot = maybe.groupBy("__key").count().where(F.col("count") > per_salt).select("__key", F.ceil(F.col("count") / per_salt).cast("int").alias("__salts"), "count").orderBy(F.desc("count")).limit(most_hot)
    many = {r["__key"]: r["__salts"] for r in hot.toLocalIterator()}
    salts = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in many.items() for x in kv)), F.col("__key")), F.lit(1)) if many else F.lit(1)
    spread = keys.select("__key", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"), F.lit("block").alias("__listed"))
    maybe = maybe.withColumn("__salt", F.least(F.floor(F.rand(9) * salts).cast("int"), salts - 1))
    exact = maybe.join(spread, ["__key", "__salt"], "left").select(*(F.col(f"`{c}`") for c in cols), F.coalesce("__listed", F.lit("allow")).alias("verdict"))
    return sure.unionByName(exact)
