"""Compares a query's rows with its SQL in DuckDB, whatever their order."""

import glob
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(normal, value))
    return str(value) if value is not None and not isinstance(value, (int, str, bool)) else value


def assert_same(df, sql, sf_dir):
    names, want = expected(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted(([normal(r[c]) for c in order] for r in df.collect()), key=repr)
    at = [names.index(c) for c in order]
    assert got == sorted(([normal(r[i]) for i in at] for r in want), key=repr)
