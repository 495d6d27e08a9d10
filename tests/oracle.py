"""Compares a query's rows with those of its SQL in DuckDB."""

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{sf_dir}/{t}.parquet') else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def differences(spark_df, con, sql):
    got_names = sorted(spark_df.columns)
    rel = con.sql(sql)
    want_names = sorted(rel.columns)
    if got_names != want_names:
        return f"columns {got_names} and {want_names}"
    order = [rel.columns.index(c) for c in want_names]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    got = Counter(tuple(plain(x) for x in r) for r in spark_df.select(*[f"`{c}`" for c in got_names]).collect())
    if want != got:
        return f"{sum(got.values())} and {sum(want.values())} rows; only Spark: {list((got - want).items())[:3]}; only SQL: {list((want - got).items())[:3]}"
    return None if want else "no rows"
