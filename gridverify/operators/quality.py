"""Missing-value counts, outlier counts and data summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.functions.values import clean
from gridverify.schema import CELL, require, value_columns

# Fixed value: values above this count as outliers unless told otherwise.
OUTLIER_THRESHOLD = 500


def missing_count(df: DataFrame, value: str = "value") -> DataFrame:
    require(df, value, error=KeyError)
    return df.agg(F.count_if(clean(value).isNull()).alias("missing"))


def outlier_count(
    df: DataFrame, value: str = "value", threshold: float = OUTLIER_THRESHOLD
) -> DataFrame:
    require(df, value, error=KeyError)
    return df.agg(F.count_if(clean(value) > F.lit(float(threshold))).alias("outliers"))


def quality_counts(
    df: DataFrame, value: str = "value", threshold: float = OUTLIER_THRESHOLD
) -> DataFrame:
    """Both counts in one scan."""
    require(df, value, error=KeyError)
    v = clean(value)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(v.isNull()).alias("missing"),
        F.count_if(v > F.lit(float(threshold))).alias("outliers"),
    )


def profile(
    df: DataFrame,
    *,
    time: str = "time",
    member: str = "member",
    values: Sequence[str] | None = None,
) -> DataFrame:
    """One row describing a dataset: rows, distinct times, cells and members, ranges.

    Each distinct count is an aggregation of its own over its columns alone: counted
    together, also in subqueries that Spark merges, every row would be copied once for each.
    """
    cells = [c for c in CELL if c in df.columns]

    def distinct(name: str, *columns: str) -> Column:
        labels = df.select(*columns).dropna().distinct()
        return labels.agg(F.count(F.lit(1))).scalar().alias(name)

    once = [F.count(F.lit(1)).alias("n_rows")]
    shown: list[str | Column] = ["n_rows"]
    if time in df.columns:
        once += [F.min(time).alias("first_time"), F.max(time).alias("last_time")]
        shown += [distinct("n_times", time), "first_time", "last_time"]
    if cells:
        shown.append(distinct("n_cells", *cells))
    if member in df.columns:
        shown.append(distinct("n_members", member))
    for v in values if values is not None else value_columns(df):
        once += [
            F.count(clean(v)).alias(f"n_{v}"),
            F.min(clean(v)).alias(f"min_{v}"),
            F.max(clean(v)).alias(f"max_{v}"),
        ]
        shown += [f"n_{v}", f"min_{v}", f"max_{v}"]
    return df.agg(*once).select(*shown)
