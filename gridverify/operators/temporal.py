"""Aggregation over members, calendar periods and weather types.

Every operator is one ``groupBy`` with built-in aggregates, so Spark combines
rows in the map tasks before it shuffles and a cell or period that holds much
of the data reaches the reducer as one partial row per map task.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.functions.calendar import period_label
from gridverify.functions.values import clean
from gridverify.operators.reuse import reuse
from gridverify.schema import dimension_columns, require

METHODS = ("sum", "mean")
PASS_THROUGH = ("none", "hourly")

# A table of days and weather types with at most this many rows is broadcast; the keys
# that a day is spread over otherwise.
BROADCAST_DAYS = 1_000_000
SPREAD = 64


def reduced(value: str | Column, method: str, min_count: int = 0) -> Column:
    """Skip-NULL sum or mean. A sum of nothing is 0 unless ``min_count`` asks for more."""
    if method not in METHODS:
        raise ValueError(f"unsupported aggregation method {method!r}; choose 'sum' or 'mean'")
    if method == "mean":
        return F.avg(value)
    total = F.sum(value)
    if min_count > 0:
        return F.when(F.count(value) >= min_count, total)
    return F.coalesce(total, F.lit(0.0))


def ensemble_mean(df: DataFrame, value: str = "value", member: str = "member") -> DataFrame:
    """Mean over members; data without members is returned as it is."""
    if member not in df.columns:
        return df
    keys = [c for c in dimension_columns(df) if c != member]
    return df.groupBy(*keys).agg(F.avg(clean(value)).alias(value))


def aggregate_time(
    df: DataFrame,
    period: str,
    *,
    method: str = "sum",
    value: str = "value",
    time: str = "time",
    missing_value: float | None = None,
    compute_ens_mean: bool = False,
    min_count: int = 0,
) -> DataFrame:
    """Aggregate to "daily", "monthly", "seasonal" or "yearly" values per cell and member.

    Days are labelled with their date, months and years with their last day;
    "seasonal" pools all years under a ``season`` column that replaces the
    time. "none", "hourly" and unknown periods only repair missing values.
    """
    require(df, value, time)
    aggregate = reduced(value, method, min_count)
    df = df.withColumn(value, clean(value, missing_value))
    if compute_ens_mean:
        df = ensemble_mean(df, value)
    label = period_label(period, time)
    if label is None:
        if period not in PASS_THROUGH:
            warnings.warn(f"unknown aggregation period {period!r}; data used as they are")
        return df
    name, expression = label
    keys = [c for c in dimension_columns(df) if c not in (time, name)]
    return df.groupBy(expression.alias(name), *keys).agg(aggregate.alias(value))


def weather_type_mean(
    df: DataFrame,
    weather: DataFrame,
    *,
    value: str = "value",
    time: str = "time",
    weather_time: str = "time",
    weather_type: str = "slwt",
    compute_ens_mean: bool = False,
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """Mean per weather type, cell and member over all time steps on days of that type.

    Data are first reduced to one sum and count per day, cell and member. Only
    those partial rows meet the weather table, so a busy day is not joined row
    by row with each of its types. The table of days and types is counted and
    broadcast; if it is too long for that, a day's rows are spread over several
    keys. ``held`` gets that table if it is cached; see ``reuse``.
    """
    require(df, value, time)
    if compute_ens_mean:
        df = ensemble_mean(df, value)
    keys = [c for c in dimension_columns(df) if c != time]
    daily = df.groupBy(F.to_date(time).alias("day"), *keys).agg(
        F.sum(clean(value)).alias("_sum"), F.count(clean(value)).alias("_n")
    )
    types = weather.select(
        F.to_date(weather_time).alias("day"), F.col(weather_type).alias("slwt")
    ).distinct()
    types = reuse(types, held)
    if types.count() <= BROADCAST_DAYS:
        joined = daily.join(F.broadcast(types), "day")
    else:
        part = F.pmod(F.xxhash64(*keys), F.lit(SPREAD)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
        joined = daily.withColumn("_part", part).join(
            types.withColumn("_part", copies), ["day", "_part"]
        )
    mean = F.try_divide(F.sum("_sum"), F.sum("_n"))
    return joined.groupBy("slwt", *keys).agg(mean.alias(value))
