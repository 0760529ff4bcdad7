"""Comparison of a Spark result with the same query in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from tablepulse.catalog.tables import BASE

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in BASE:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else f"{value:.6f}".replace("-0.000000", "0.000000")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    columns = [c[0] for c in cursor.description]
    return _sorted(columns, cursor.fetchall())


def type_differences(df, connection, sql):
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    duck = {row[0]: row[1] for row in described}
    return {
        name: (kind, duck.get(name))
        for name, kind in df.dtypes
        if kind in KINDS and KINDS[kind] != duck.get(name)
    }


def differences(df, connection, sql):
    """Empty when columns, types and rows agree."""
    spark_columns, spark = spark_rows(df)
    duck_columns, duck = duck_rows(connection, sql)
    out = []
    if spark_columns != duck_columns:
        out.append(f"columns {spark_columns} vs {duck_columns}")
    kinds = type_differences(df, connection, sql)
    if kinds:
        out.append(f"types {kinds}")
    if len(spark) != len(duck):
        out.append(f"{len(spark)} vs {len(duck)} rows")
    if spark != duck:
        only = [r for r in spark if r not in set(duck)][:2], [r for r in duck if r not in set(spark)][:2]
        out.append(f"only Spark {only[0]}, only DuckDB {only[1]}")
    return out
