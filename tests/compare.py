"""Runs a query on Spark and its SQL on DuckDB over the same tables, and compares rows without regard to order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connection():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        x = x.replace(tzinfo=None)
    return str(x)


def differences(df, rel):
    cols = sorted(df.columns)
    if cols != sorted(rel.columns):
        return f"columns {cols} and {sorted(rel.columns)}"
    a = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    b = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    kinds = [(c, k, str(rel.types[rel.columns.index(c)])) for c, k in df.dtypes if {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(k, str(rel.types[rel.columns.index(c)])) != str(rel.types[rel.columns.index(c)])]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, as {bad[:2]}"
    return f"types {kinds}" if kinds else "" if a else "no rows"
