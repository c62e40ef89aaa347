"""Runs queries beside their oracle SQL: rows as multisets, columns by name."""

from __future__ import annotations

import math
import os
from collections import Counter
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, f, sql: str, db=None) -> str:
    """Empty if both give the same rows."""
    df = f(spark, sf_dir)
    mine = bag(df.columns, [tuple(r) for r in df.collect()])
    cursor = (db or database(sf_dir)).execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = bag(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}"
    return ""
