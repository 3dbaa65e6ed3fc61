"""Compare a Spark result with DuckDB's for the same tables, rows in any order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import numpy as np


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return plain(v.item()) if hasattr(v, "item") else v


def rows_of(df) -> tuple[list[str], Counter]:
    columns = sorted(df.columns)
    return columns, Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def rows_by_sql(folder: str, sql: str) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = con.sql(sql)
    columns = sorted(got.columns)
    at = [got.columns.index(c) for c in columns]
    return columns, Counter(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())
