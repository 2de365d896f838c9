"""Run a query in Spark and its SQL in DuckDB and compare the results exactly."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return float(int(value)) if value == int(value) and abs(value) < 2**53 else value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r))


def compare(spark_df, con, sql: str) -> list[str]:
    """Empty when equal, else a few lines on what differs."""
    got_names, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want_names, want = rows_of([d[0] for d in rel.description], rel.fetchall())
    problems = []
    if got_names != want_names:
        problems.append(f"columns {got_names} != {want_names}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    if not problems and got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w]
        problems.append(f"{len(bad)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}")
    return problems
