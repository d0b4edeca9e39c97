"""Holds queries against their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if v.__class__.__name__ in ("Decimal", "datetime", "date", "Timestamp") else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(df, con, sql: str) -> str | None:
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want, got = rows(names, cursor.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, not {sorted(names)}"
    if len(want) != len(got):
        return f"{len(got)} rows, not {len(want)}"
    return next((f"{g}, not {w}" for g, w in zip(got, want, strict=True) if g != w), None)
