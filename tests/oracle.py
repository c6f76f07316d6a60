"""Compares a query's rows with its SQL's on DuckDB, values as they print."""

import os

import duckdb
import pandas as pd


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}


def connect(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and pd.isna(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    cur = connect(sf_dir).execute(sql)
    names = [c[0] for c in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(names) == sorted(df.columns)
    kinds = {c[0]: TYPES[str(c[1])] for c in cur.description}
    assert {n: t.removesuffix("_ntz") for n, t in df.dtypes} == kinds
    key = lambda rows: sorted(repr([(n, plain(r[n])) for n in sorted(names)]) for r in rows)
    assert key(got) == key(want)
