"""Rows of a Spark and a DuckDB result in a common form."""

import os

import duckdb
import pandas as pd


def connected(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, float):
            return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(round(v, 9))
        return str(v)

    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)
