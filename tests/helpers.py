"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v: object) -> str:
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def by_sql(sql: str, sf: str) -> tuple[list[str], list[tuple[str, ...]]]:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(sql)
    cols = [d[0] for d in r.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(tuple(norm(row[i]) for i in order) for row in r.fetchall())


def by_spark(df) -> tuple[list[str], list[tuple[str, ...]]]:
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
