"""Runs a registered query beside its SQL in DuckDB and compares rows, whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "as_tuple"):
        return plain(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, bool) else int(x)) if x is not None else (True, "", 0) for x in r))


def compare(df, sql: str, sf_dir: str) -> str:
    """Empty when equal, or what differs."""
    got = df.collect()
    con = connect(sf_dir)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = rows(names, want.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    found = rows(df.columns, got)
    if len(found) != len(expected):
        return f"{len(found)} rows against {len(expected)}: {found[:2]} {expected[:2]}"
    for a, b in zip(found, expected, strict=True):
        if a != b:
            return f"{a} against {b}"
    return ""
