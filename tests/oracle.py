"""Compares a query with its SQL, the way the driver does: rows as a multiset, columns by name."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, bool):
        return v
    return float(v) if isinstance(v, int) else v


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(plain(v)) for v in r) for r in df.itertuples(index=False))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(spark, sf_dir: str, query, sql: str) -> int:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return len(got)
