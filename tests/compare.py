"""A Spark result against DuckDB's on the same tables."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.11g}")
    if hasattr(v, "as_tuple"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def sql_rows(sql, data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    columns = sorted(names)
    return columns, Counter(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())


def assert_same(df, sql, data):
    (a, x), (b, y) = spark_rows(df), sql_rows(sql, data)
    assert a == b
    assert x == y, (list((x - y))[:3], list((y - x))[:3])
