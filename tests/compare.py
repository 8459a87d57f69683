"""Rows of a Spark query and of its SQL, in one order and one spelling."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(v) for v in row) for row in df.astype(object).itertuples(index=False))
