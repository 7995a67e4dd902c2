"""Comparison of a Spark query with its SQL in DuckDB."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def _value(v):
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_value(r[k]) for k in order) for r in rows)


def assert_same(spark, con, query, sql, sf_dir=SF):
    df = query(spark, sf_dir)
    expected = con.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(expected.columns, expected.fetchall())
