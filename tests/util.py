"""Helpers of the tests."""

from __future__ import annotations

import glob
import os

import numpy as np
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def plain(x):
    """A value as both engines agree on it."""
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (float, np.floating)):
        return None if np.isnan(x) else float(f"{x:.8g}")
    if isinstance(x, (np.bool_, bool)):
        return bool(x)
    if isinstance(x, (int, np.integer)):
        return float(x)
    if isinstance(x, pd.Timestamp):
        return str(x)[:26]
    if isinstance(x, (list, np.ndarray)):
        return str([plain(v) for v in x])
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False, name=None)), key=str)


def database(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def empty_tables(spark, folder: str, to: str) -> str:
    """All tables of a folder without their rows."""
    for path in glob.glob(f"{folder}/*.parquet"):
        spark.read.parquet(path).limit(0).write.mode("overwrite").parquet(f"{to}/{os.path.basename(path)}")
    return to
