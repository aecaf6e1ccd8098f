"""Comparing a query with its SQL in DuckDB, row order aside."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def rows(frame):
    columns = sorted(frame.columns)

    def text(v):
        if v is None or v is False or v is True or isinstance(v, str):
            return str(v)
        return repr(float(v) + 0.0)

    clean = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(tuple(text(v) for v in r) for r in clean.itertuples(index=False, name=None))


def duck(sql, data=DATA):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c.execute(sql).df()


def same(spark, query, sql, data=DATA):
    got, want = rows(query(spark, data).toPandas()), rows(duck(sql, data))
    assert got[0] == want[0]
    assert got[1] == want[1]
