"""Rows of a query against rows of its SQL in DuckDB, as multisets."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else 0.0 if v == 0 else v
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def same(df, sql, connection):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected, found = rows_of(columns, result.fetchall()), rows_of(df.columns, df.collect())
    assert expected == found, (list((found - expected).items())[:3], list((expected - found).items())[:3])
