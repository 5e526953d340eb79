"""A query's rows held against those of its SQL in DuckDB."""

import decimal
import glob
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return v


def compare(spark, folder, query, sql):
    df = query(spark, folder)
    result = connect(folder).execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(v) for v in row) for row in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert len(got) == len(want) and got == want
