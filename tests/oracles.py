"""Compares every registered query with its DuckDB form on one of the test folders."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if v is not None else None


def compare(spark, con, folder: str, run, sql: str) -> str:
    """Empty, or what differs."""
    df = run(spark, folder)
    names = sorted(df.columns)
    have = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    if sorted(columns) != names:
        return f"columns {sorted(columns)} and {names}"
    order = [columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)
    if have == want:
        return ""
    odd = [(a, b) for a, b in zip(have, want) if a != b][:3]
    return f"{len(have)} and {len(want)} rows, first differences {odd}"
