"""Order-insensitive comparison of a query with its SQL on the same Parquet tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf=SF):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def cell(v):
    if v is None or str(v) in ("nan", "NaT", "<NA>"):
        return "~"
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return str(bool(v))
    if hasattr(v, "__float__") and not isinstance(v, str):
        f = float(v)
        return str(int(f)) if math.isfinite(f) and f == int(f) and abs(f) < 1e15 else f"{f:.8g}"
    return str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(cell(v) for v in r) for r in frame[names].itertuples(index=False))
