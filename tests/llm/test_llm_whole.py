"""Queries of docloom.llm do the whole job: nothing is left out by a cap, a prefix or a filter on ids."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def sf01(sf):
    return os.path.join(os.path.dirname(sf), "sf0.1")


def test_list_has_subdomains_of_junk_hosts(spark, sf01):
    from docloom.llm import queries as Q
    from docloom.llm import urlfilter as U

    hosts = ["spam-farm.example.org", "www.spam-farm.example.org", "m.casino-win.example.net", "blog.cheap-pills.example.com", "free-bets.example.com", "nospam-farm.example.org", "spam-farm", "a.org"]
    some = spark.createDataFrame([(f"http://{h}/x",) for h in hosts], "url string")
    assert {r.url for r in Q.listed_pages(some).collect()} == {f"http://{h}/x" for h in hosts[:5]}
    pages = spark.read.parquet(f"{sf01}/pages.parquet")
    listed = Q.listed_pages(pages)
    assert listed.count() == 95
    key = U.canonical(U.host_of(F.col("url")), U.path_of(F.col("url")))
    bloom = U.BlockedBloom(listed.select(key.alias("k")).distinct(), "k")
    assert bloom.table.any() and bloom.mark(pages, key).where("__maybe").count() >= 95


def test_listed_pages_are_blocked_without_a_rule(spark, tmp_path):
    from docloom.llm import queries as Q

    rows = [(1, "http://www.spam-farm.example.org/a"), (2, "http://blog.casino-win.example.net/b"), (3, "http://news.example.org/c"), (4, "http://www.spam-farm.example.com/d")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in Q.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow"}  # the rule com/ allows the last


def test_training_windows_come_from_all_texts():
    import numpy as np

    from docloom.llm import pii

    texts = [" ".join(f"d{i}x{k} call +1 (555) 123-4567 now" for k in range(200)) for i in range(40)]
    examples, words = pii._sample(texts, np.random.default_rng(1), 300)
    assert len(examples) == 300 and any(spans for _, spans in examples)
    seen = {w.split("x")[0] for cut, _ in examples for w in cut.split() if w.startswith("d") and "x" in w}
    assert len(seen) == 40 and len({w.split("x")[0] for w in words if "x" in w}) == 40
    assert pii._sample([], np.random.default_rng(1), 300) == ([], [])
