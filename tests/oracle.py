"""Comparing a query with its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    """A text that tells a number from a text, a truth value and null."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return f"?{v}"
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return f"#{float(v):.6g}" if float(v) != int(v) else f"#{int(v)}"
    return f"'{v}" if isinstance(v, str) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows."""
    got = df.collect()
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    a, b = rows(df.columns, got), rows(names, want.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; first {a[:2]} and {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else ""
