"""Compares a query with its SQL on one table folder: rows as multisets, columns by name."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        for p in glob.glob(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.6g}" if v else "0"
    return str(v)


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_key(x) for x in r) for r in frame.astype(object).itertuples(index=False))


def differ(query, sql: str, spark, sf_dir: str) -> str | None:
    got, want = query(spark, sf_dir).toPandas(), duck(sf_dir).sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]
        return f"{len(a)} and {len(b)} rows, {bad}"
    return None
