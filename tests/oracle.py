"""Runs a query's SQL in DuckDB and compares the rows as multisets."""

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float | np.floating) and math.isnan(v)):
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | float | np.integer | np.floating):
        return round(float(v), 6) + 0.0
    if isinstance(v, pd.Timestamp | datetime.datetime):
        return v.isoformat()[:19]
    if isinstance(v, datetime.date):
        return v.isoformat() + "T00:00:00"
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(frame: pd.DataFrame) -> list:
    names = sorted(frame.columns)
    return sorted((tuple(_plain(x) for x in r) for r in frame[names].itertuples(index=False, name=None)), key=repr)


def expected(sql: str, sf: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).fetchdf()


def same(got: pd.DataFrame, want: pd.DataFrame, tolerance: float = 2.1e-5) -> None:
    """Asserts equal rows; numbers may differ by a unit of the fifth place, where both sides round."""
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return
    order = lambda r: repr([(round(x, 2) if isinstance(x, float) and x != int(x) else x) for x in r])
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=order), sorted(b, key=order), strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= tolerance) for p, q in zip(x, y, strict=True)), (x, y)
