"""Runs a query on Spark and its SQL on DuckDB over the same Parquet tables."""

import decimal
import os

import duckdb


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value) if value % 1 else int(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def connection(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def same(spark, con, folder: str, build, sql: str, may_be_empty: bool = False) -> None:
    df = build(spark, folder)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
    assert ours or may_be_empty, "an empty result shows nothing"
