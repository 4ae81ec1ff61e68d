"""Run queries beside their DuckDB twins and compare names, types and rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connection(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def _plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


def difference(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs between a DataFrame and a query's result; empty if nothing does."""
    names = sorted(df.columns)
    mine = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=repr)
    found = con.sql(sql)
    if sorted(found.columns) != names:
        return f"columns {names} and {sorted(found.columns)}"
    kinds = dict(zip(found.columns, map(str, found.types), strict=True))
    odd = [(n, t, kinds[n]) for n, t in df.dtypes if KINDS.get(t, t) != kinds[n]]
    place = [found.columns.index(n) for n in names]
    theirs = sorted((tuple(_plain(r[i]) for i in place) for r in found.fetchall()), key=repr)
    if mine != theirs:
        first = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
        return f"{len(mine)} and {len(theirs)} rows, first difference {first}"
    return f"types {odd}" if odd else "" if mine else "no rows"
