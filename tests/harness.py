"""Compares a query with its SQL on the same tables, as sorted rows of normalised values."""
from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if f.is_dir() else ''}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "None" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([norm(r[i]) for i in order] for r in rows)


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = table_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        a = [r for r in got[1] if r not in want[1]][:3] if len(got[1]) < 5000 else []
        b = [r for r in want[1] if r not in got[1]][:3] if len(want[1]) < 5000 else []
        return f"{len(got[1])} and {len(want[1])} rows; {a} / {b}"
    return None
