"""Area-mean series, linear trends and mean cycles."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridverify.functions.calendar import CYCLE_STEPS, cycle_step
from gridverify.functions.values import clean
from gridverify.operators.lines import Line, line_values
from gridverify.schema import CELL, dimension_columns, dimension_list, present, require

LINE_KEYS = ("line", "source")


def area_mean(
    df: DataFrame,
    *,
    value: str = "value",
    by: Sequence[str] = (),
    reduce_dims: Sequence[str] | str | None = None,
) -> DataFrame:
    """Unweighted mean over the cells, or over ``reduce_dims`` if given."""
    require(df, value)
    dropped = dimension_list(reduce_dims) or list(CELL)
    keys = [*by, *(d for d in dimension_columns(df) if d not in dropped)]
    return df.groupBy(*keys).agg(F.avg(clean(value)).alias(value))


def reduced_lines(
    ensemble: DataFrame | None,
    reference: DataFrame | None,
    lines: Sequence[Line],
    reduce_dims: Sequence[str] | str | None = None,
    *,
    always: bool = False,
    **values: str,
) -> DataFrame:
    """Rows of the lines, averaged over each line's ``reduce_dims``, or over those given for all.

    Lines without any keep their rows, or with ``always`` are averaged over the cells.
    All averaged lines share one aggregation: a dimension that a line is averaged over
    is NULL in that line's key. So each dataset is read once for them, and once more if
    others keep their rows.
    """
    numbers: dict[tuple[str, tuple[str, ...]], int] = {}
    averaged, plain = [], []
    for line in lines:
        dims = dimension_list(line.reduce_dims) or dimension_list(reduce_dims)
        if not dims and always:
            dims = list(CELL)
        if dims:
            number = numbers.setdefault((line.label, tuple(dims)), len(numbers))
            averaged.append(replace(line, label=str(number)))
        else:
            plain.append(line)
    parts = []
    if averaged:
        rows = line_values(ensemble, reference, averaged, **values)
        number = F.col("line").cast("int")
        keys = [F.element_at(F.array(*[F.lit(label) for label, _ in numbers]), number + 1).alias("line"), F.col("source")]
        for d in dimension_columns(rows):
            over = [n for (_, dims), n in numbers.items() if d in dims]
            if len(over) < len(numbers):
                keys.append(F.when(~number.isin(over), F.col(d)).alias(d) if over else F.col(d))
        found = rows.groupBy(number.alias("_number"), *keys).agg(F.avg(clean("value")).alias("value"))
        parts.append(found.drop("_number"))
    if plain:
        parts.append(line_values(ensemble, reference, plain, **values))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def line_series(
    ensemble: DataFrame | None,
    reference: DataFrame | None,
    lines: Sequence[Line],
    *,
    reduce_dims: Sequence[str] | str | None = None,
    **values: str,
) -> DataFrame:
    """One area-mean series per line, and per member where a line keeps its members."""
    return reduced_lines(ensemble, reference, lines, reduce_dims, always=True, **values)


def add_trend(
    series: DataFrame, *, by: Sequence[str] = ("line", "source", "member"), value: str = "value"
) -> DataFrame:
    """Add ``trend``: the straight line fitted to each series on whole days.

    NULL for a series with fewer than two values. The fit is an aggregate with
    one row per series, joined back; equal-null matching keeps memberless lines.
    """
    keys = present(series, by)
    day = F.unix_date(F.to_date("time")).cast("double")
    fit = series.groupBy(*keys).agg(
        F.regr_slope(F.col(value), day).alias("_slope"),
        F.regr_intercept(F.col(value), day).alias("_intercept"),
        F.regr_count(F.col(value), day).alias("_n"),
    )
    fitted = F.when(F.col("_n") >= 2, F.col("_slope") * day + F.col("_intercept"))
    if not keys:
        line = {c: fit.select(c).scalar() for c in fit.columns}
        return series.withColumns(line).select(*series.columns, fitted.alias("trend"))
    fit = fit.select(*[F.col(k).alias(f"_{k}") for k in keys], "_slope", "_intercept", "_n")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return series.join(fit, same).select(*series.columns, fitted.alias("trend"))


def mean_cycle(
    series: DataFrame, cycle: str, *, value: str = "value", time: str = "time"
) -> DataFrame:
    """Mean of a series per hour, day of year, month, season or year.

    A mean of the area means, not a mean over all cells and times at once. An
    unknown cycle gives no rows.
    """
    keys = [c for c in series.columns if c not in (time, value, "trend")]
    if cycle not in CYCLE_STEPS:
        warnings.warn(f"unknown cycle {cycle!r}; choose from {list(CYCLE_STEPS)}")
        empty = series.select(*keys, F.lit(None).cast("int").alias("step"), value)
        return empty.where(F.lit(False))
    name, step = cycle_step(cycle, time)
    return series.groupBy(*keys, step.alias(name)).agg(F.avg(value).alias(value))


def line_cycle(
    ensemble: DataFrame | None,
    reference: DataFrame | None,
    lines: Sequence[Line],
    cycle: str = "monthly",
    *,
    reduce_dims: Sequence[str] | str | None = None,
    **values: str,
) -> DataFrame:
    series = line_series(ensemble, reference, lines, reduce_dims=reduce_dims, **values)
    return mean_cycle(series, cycle)
