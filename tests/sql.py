"""Run a query in Spark and its SQL in DuckDB, and compare rows whatever their order."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    c = duckdb.connect()
    for t in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(t)[:-8]} AS SELECT * FROM read_parquet('{t}')")
    return c


def norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


def same_rows(spark, c, query, sql, sf=SF):
    df = query(spark, sf)
    got = [tuple(r) for r in df.collect()]
    r = c.sql(sql)
    columns, want = r.columns, r.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    a = sorted(tuple(norm(x[i]) for i in order(df.columns)) for x in got)
    b = sorted(tuple(norm(x[i]) for i in order(columns)) for x in want)
    assert a == b
    return len(a)
