"""A query's rows against its SQL's, run by DuckDB over the smallest tables."""

from __future__ import annotations

import decimal
import os
from collections import Counter

import duckdb

from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def agrees(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    df = query(spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert got == Counter(tuple(map(plain, r)) for r in found.fetchall())
