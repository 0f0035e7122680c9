"""Holds a query against its SQL on the same files, by DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb

from factloom.sources.tables import TABLES


def _norm(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_norm, v))
    if hasattr(v, "tzinfo") and v.tzinfo:
        v = v.replace(tzinfo=None)
    return str(v) if hasattr(v, "isoformat") else round(float(v), 6)


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(repr([_norm(r[i]) for i in order]) for r in table)


def check(df, sql, folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    r = con.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(r.columns, r.fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])
