"""Comparison of a query's result with its SQL form in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = ("lineitem", "supplier", "orders", "events")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    return con


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _normal(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        # Six decimals on both sides; -0.0 must not occur.
        return repr(v)
    return repr(v)


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_normal(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """Reasons why the two results differ, empty if they are equal."""
    names = spark_df.columns
    ours = normal_rows(names, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    their_names = [d[0] for d in cursor.description]
    theirs = normal_rows(their_names, cursor.fetchall())
    problems = []
    if sorted(names) != sorted(their_names):
        problems.append(f"columns {sorted(names)} != {sorted(their_names)}")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    if ours != theirs and not problems:
        off = [(a, b) for a, b in zip(ours, theirs) if a != b]
        problems.append(f"{len(off)} rows differ, first {off[0]}")
    return problems
