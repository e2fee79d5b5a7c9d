"""Expressions on the value column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: offset between Kelvin and degrees Celsius.
KELVIN_OFFSET = 273.15


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(value: str | Column, missing_value: float | None = None) -> Column:
    """Turn NaN, and the missing-value sentinel if one is given, into NULL.

    Spark's ``sum`` and ``avg`` skip NULL but not NaN, and ``NaN >= x`` holds,
    so this belongs in front of every mask and reduction.
    """
    v = _col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    return v if missing_value is None else F.nullif(v, F.lit(float(missing_value)))


def scaled(value: str | Column, factor: float) -> Column:
    return _col(value) * F.lit(float(factor))


def kelvin_to_celsius(value: str | Column) -> Column:
    return _col(value) - F.lit(KELVIN_OFFSET)


def to_celsius(value: str | Column, units: str | Column) -> Column:
    """Celsius value for a units *column*.

    A unit holding a "c" counts as Celsius, else one holding a "k" as Kelvin;
    no unit at all is taken as Kelvin and any other unit is left alone.
    """
    v, u = _col(value), F.lower(F.coalesce(_col(units), F.lit("")))
    kelvin = ~u.contains("c") & (u.contains("k") | (u == ""))
    return F.when(kelvin, kelvin_to_celsius(v)).otherwise(v)


def in_half_open(value: str | Column, low: float, high: float) -> Column:
    """``low <= value < high``; NULL counts as outside."""
    v = _col(value)
    return F.coalesce((v >= F.lit(float(low))) & (v < F.lit(float(high))), F.lit(False))
