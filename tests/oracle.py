"""Runs a registered query and its DuckDB statement over the same tables and compares all rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t))


def compare(spark: SparkSession, sf_dir: str, query, sql: str, con=None) -> dict:
    con = con or connect(sf_dir)
    df = query(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = _rows(names, cur.fetchall())
    types = dict(df.dtypes)
    return {
        "columns": sorted(df.columns) == sorted(names),
        "rows": (len(got), len(want)),
        "equal": got == want,
        "diff": [(a, b) for a, b in zip(got, want) if a != b][:3],
        "types": {n: (types.get(n), str(t[1])) for n, t in zip(names, cur.description)},
    }
