"""Comparison of a query's rows with those of its SQL in DuckDB on the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


def compare(df, con, sql):
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    types = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    order = [rel.columns.index(c) for c in names]
    want = sorted((tuple(plain(x[i]) for i in order) for x in rel.fetchall()), key=repr)
    assert got == want
