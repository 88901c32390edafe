"""Run a query and its SQL side by side and compare values."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return float(x)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=repr)


def difference(df, con, sql) -> str | None:
    """None if equal, else a short description."""
    got = df.collect()
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    expected = rows_of(names, want.fetchall())
    actual = rows_of(df.columns, got)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}; first {actual[:1]} / {expected[:1]}"
    wrong = [(a, b) for a, b in zip(actual, expected) if a != b]
    if wrong:
        a, b = wrong[0]
        cells = [(n, x, y) for n, x, y in zip(sorted(names), a, b) if x != y]
        return f"{len(wrong)} of {len(actual)} rows differ, e.g. {cells[:4]}"
    return None
