"""Per-cell fields behind the map figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridverify.functions.values import clean
from gridverify.operators.temporal import reduced
from gridverify.schema import CELL, dimension_columns, require


def time_map(
    df: DataFrame, method: str = "sum", *, value: str = "value", time: str = "time"
) -> DataFrame:
    """Sum or mean over time, per cell and member."""
    keys = [d for d in dimension_columns(df) if d not in (time, "season")]
    return df.groupBy(*keys).agg(reduced(clean(value), method).alias(value))


def map_difference(first: DataFrame, second: DataFrame, value: str = "value") -> DataFrame:
    """``first - second`` on the dimensions both maps have."""
    shared = [d for d in dimension_columns(first) if d in second.columns]
    right = second.select(*dimension_columns(second), F.col(value).alias("_second"))
    joined = first.join(right, shared)
    return joined.withColumn(value, F.col(value) - F.col("_second")).drop("_second")


def member_panels(scores: DataFrame, metric: str) -> DataFrame:
    """One map of a metric per member."""
    require(scores, "member", metric)
    return scores.select("member", *CELL, F.col(metric).alias("score"))


def single_map(scores: DataFrame, metric: str) -> DataFrame:
    """One map of a metric; the query fails if a cell has more than one member."""
    require(scores, metric)
    if "member" not in scores.columns:
        return scores.select(*CELL, F.col(metric).alias("score"))
    one = F.min("member").eqNullSafe(F.max("member"))
    message = "a single map needs a single member; use member_panels"
    checked = scores.groupBy(*CELL).agg(F.max(metric).alias("score"), one.alias("_one"))
    return checked.where(F.assert_true(F.col("_one"), message).isNull()).drop("_one")


def band_panels(df: DataFrame, value: str = "value") -> DataFrame:
    """One map per altitude band: mean over everything but the cell, by lower edge."""
    require(df, "bin_min", "bin_max")
    keys: Sequence[str] = ("bin_min", "bin_max", *CELL)
    return df.groupBy(*keys).agg(F.avg(value).alias(value)).orderBy("bin_min", *CELL)
