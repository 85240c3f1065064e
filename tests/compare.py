"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf: str):
    con = duckdb.connect()
    for f in sorted(glob.glob(f"{sf}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, int):
        return v
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in data), key=repr
    )


def difference(spark, con, fn, sql, sf):
    """None when equal, otherwise a short description."""
    df = fn(spark, sf)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_cols, want = rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"rows {len(got)} != {len(want)}; spark only {list(a - b)[:3]}; sql only {list(b - a)[:3]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[0]}"
    types = [(g, type(x), type(y)) for g, x, y in zip(got_cols, got[0], want[0]) if type(x) is not type(y)] if got else []
    return f"types {types}" if types else ("no rows" if not got else None)
