"""Runs a query and its oracle side by side and compares their rows, whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def canonical(frame: pd.DataFrame) -> list:
    def text(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return format(v, ".12g") if isinstance(v, float) else str(v)

    return sorted((tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False)), key=str)


def same(spark, run, oracle: str, folder: str) -> None:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    got, want = run(spark, folder).toPandas(), con.execute(oracle).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
