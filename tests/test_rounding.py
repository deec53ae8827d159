"""Results at halves of the last decimal place are those of the SQL."""

from __future__ import annotations

import duckdb
import pytest

from docloom import registry
from helpers import norm


def _text() -> str:
    """Distances that would be equal if rounded by decimal digits: 1 - 0.6708203925 and 1 - 0.670820393, the rest near 0."""
    return ". ".join(" ".join([w] * 30) for w in ["ering", "nder", *["ndd"] * 10])


@pytest.mark.parametrize("name", ["chunk_percentile_boundaries", "chunk_percentile"])
def test_chunks_at_nearly_equal_distances(spark, tmp_path, name):
    spark.createDataFrame([(1, _text())], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()[name](spark, str(tmp_path))
    cols = sorted(got.columns)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.execute(f"SELECT {', '.join(map('\"{}\"'.format, cols))} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(norm(r[k]) for k in cols) for r in got.collect()) == sorted(tuple(map(norm, r)) for r in want)
    assert len(want) == (1 if name.endswith("boundaries") else 2)


def test_places_are_those_of_sql(spark):
    from pyspark.sql import functions as F

    from docloom.functions.vectors import rounded, rounded_np

    import numpy as np

    x = [s * (k + 0.5) / 1e9 for k in range(670_820_000, 670_821_000) for s in (1, -1)]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(x, 9) FROM (SELECT unnest(?) AS x)", [x]).fetchall()]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(rounded(F.col("x"))).collect()] == want
    assert rounded_np(np.array(x)).tolist() == want
