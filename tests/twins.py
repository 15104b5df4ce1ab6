"""Runs a query on Spark and its SQL twin on DuckDB and compares the rows."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def _plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_plain, v)) + "]"
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "~"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(int(v)) if v == int(v) else repr(float(v))
    return str(v)


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_plain, r)) for r in frame.itertuples(index=False))


def same(spark, data, query, sql):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = query(spark, data).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
