"""Run a query on Spark and its SQL on DuckDB over one folder and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _sort_key(row):
    return tuple((value is not None, str(type(value)), value) for value in row)


def _check_types(rows):
    for row in rows:
        for value in row:
            assert not isinstance(value, (decimal.Decimal, datetime.date)), f"not a plain value: {value!r}"


def differences(query, sql, spark, connection, folder) -> str | None:
    """None when both engines return the same rows, else what differs first."""
    frame = query(spark, folder)
    names = sorted(frame.columns)
    got = sorted(([row[n] for n in names] for row in frame.collect()), key=_sort_key)
    result = connection.execute(sql)
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    order = [theirs.index(n) for n in names]
    expected = sorted(([row[i] for i in order] for row in result.fetchall()), key=_sort_key)
    _check_types(got[:100])
    _check_types(expected[:100])
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    for mine, other in zip(got, expected):
        if mine != other or [type(v) for v in mine] != [type(v) for v in other]:
            return f"{dict(zip(names, mine))} against {dict(zip(names, other))}"
    return None
