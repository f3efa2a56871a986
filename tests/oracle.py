"""Runs a registered query and its SQL and compares the rows."""

import glob
import numbers
import os

import duckdb
import pandas as pd


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple("~" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else str(round(float(v), 6)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v) for v in row))
    return sorted(out)


def differs(spark, sf, query, text):
    """None if equal, else a few rows of either side."""
    got, want = query(spark, sf).toPandas(), connect(sf).execute(text).df()
    if sorted(got.columns) != sorted(want.columns):
        return sorted(got.columns), sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return None
    left, right = set(a) - set(b), set(b) - set(a)
    return len(a), len(b), sorted(left)[:3], sorted(right)[:3]
