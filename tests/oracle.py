"""Run a query in Spark and its SQL in DuckDB and compare whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or v is math.nan or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}" if v != 0 else "0"
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(canon(v) for v in r) for r in pdf[cols].astype(object).itertuples(index=False))


def compare(spark, con, sf_dir, name, fn, sql):
    got = fn(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (name, list(got.columns), list(want.columns))
    for c in got.columns:
        kinds = got[c].dtype.kind, want[c].dtype.kind
        if len(got) and got[c].notna().all() and want[c].notna().all():
            assert kinds[0] == kinds[1], (name, c, got[c].dtype, want[c].dtype)
    _, a = rows_of(got)
    _, b = rows_of(want)
    assert len(a) == len(b), (name, "rows", len(a), len(b), a[:2], b[:2])
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diff, (name, len(diff), sorted(got.columns), diff[:3])
    return len(a)
