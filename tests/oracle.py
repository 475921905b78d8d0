"""Compares a query with its SQL on DuckDB over the same tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if x is None or x is pd.NA or x != x else f"{float(x):.5f}" if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f" else str(x)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


def differ(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if equal, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a == b:
        return ""
    x, y = set(a) - set(b), set(b) - set(a)
    return f"{len(a)} and {len(b)} rows; only here {sorted(x)[:3]}; only there {sorted(y)[:3]}"
