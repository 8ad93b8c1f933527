"""Compares a query's rows with those of its SQL in DuckDB."""

import os

import duckdb

DATA = "/root/testdata"


def connection(sf: str):
    con = duckdb.connect()
    for name in os.listdir(f"{DATA}/{sf}"):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{sf}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def same_rows(spark, query, sql: str, sf: str) -> None:
    df = query(spark, f"{DATA}/{sf}")
    names = sorted(df.columns)
    mine = sorted((plain(tuple(r)) for r in df.select(*names).collect()), key=repr)
    relation = connection(sf).sql(sql)
    assert sorted(relation.columns) == names
    theirs = sorted((plain(r) for r in relation.select(*names).fetchall()), key=repr)
    assert mine == theirs
