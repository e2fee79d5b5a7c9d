"""Value repairs and masks. Masked values become NULL; rows are kept."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.functions.values import (
    clean,
    in_half_open,
    kelvin_to_celsius,
    scaled,
    to_celsius,
)
from gridverify.schema import present, require, value_columns

# Spellings of the only supported target unit, the unit written
# after a conversion, and the names that mark a temperature variable.
CELSIUS_TARGETS = ("degc", "c", "celsius", "degree_celsius")
CELSIUS_LABEL = "degree_Celsius"
TEMPERATURE_NAMES = ("temperature", "t2m")

# Fixed value: projection metadata carried by some grids.
PROJECTION_COLUMN = "lambert_conformal_conic"


def clean_values(
    df: DataFrame, value: str = "value", missing_value: float | None = None
) -> DataFrame:
    """NaN and the sentinel become NULL."""
    return df.withColumn(value, clean(value, missing_value))


def rescale(df: DataFrame, factor: float, value: str = "value") -> DataFrame:
    return df.withColumn(value, scaled(value, factor))


def drop_projection(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*(names or (PROJECTION_COLUMN,)))


def _units_of(df: DataFrame, value: str) -> str:
    return str(df.schema[value].metadata.get("units", ""))


def unify_temperature_units(
    df: DataFrame,
    value: str = "value",
    *,
    units: str | Column | None = None,
    target: str = CELSIUS_LABEL,
) -> DataFrame:
    """Bring a temperature variable to degrees Celsius.

    ``units`` is the unit of the whole variable (default: the column's
    ``units`` metadata) or a column giving it row by row.
    """
    if value not in df.columns:
        return df
    if target.lower() not in CELSIUS_TARGETS:
        warnings.warn(f"target unit {target!r} is not supported; values left as they are")
        return df
    if isinstance(units, Column):
        return df.withColumn(value, to_celsius(value, units))
    known = (_units_of(df, value) if units is None else units).lower()
    if "c" in known:
        return df
    if known and "k" not in known:
        warnings.warn(f"unit {known!r} of {value} is unknown; values left as they are")
        return df
    if not known:
        warnings.warn(f"{value} has no unit; taken as Kelvin")
    converted = df.withColumn(value, kelvin_to_celsius(value))
    return converted.withMetadata(value, {"units": CELSIUS_LABEL})


def is_temperature(variable: str) -> bool:
    """Whether a variable's name asks for the unit conversion."""
    return any(n in variable.lower() for n in TEMPERATURE_NAMES)


def _mask(
    df: DataFrame,
    keep: Column,
    variables: Sequence[str] | None,
    zero: Column | None = None,
) -> DataFrame:
    """Values where ``keep`` holds, 0 where ``zero`` does, else NULL."""
    names = value_columns(df) if variables is None else present(df, variables)

    def masked(name: str) -> Column:
        kept = F.when(keep, F.col(name))
        return kept if zero is None else kept.when(zero, F.lit(0.0))

    # One projection, so that every variable sees the mask of the unmasked one.
    return df.withColumns({n: masked(n) for n in names})


def wet_filter(
    df: DataFrame,
    threshold: float,
    value: str = "value",
    *,
    variables: Sequence[str] | None = None,
    mask_as_zero: bool = False,
) -> DataFrame:
    """Mask every variable where ``value`` is below the threshold or missing.

    With ``mask_as_zero`` values below the threshold become 0; where ``value`` is
    missing nothing is known, and the result is missing too.
    """
    if value not in df.columns:
        warnings.warn(f"{value} not found; wet filter skipped")
        return df
    known, limit = clean(value), F.lit(float(threshold))
    return _mask(df, known >= limit, variables, known < limit if mask_as_zero else None)


def value_range(
    df: DataFrame,
    low: float,
    high: float,
    value: str = "value",
    *,
    variables: Sequence[str] | None = None,
) -> DataFrame:
    """Mask every variable where ``value`` is outside ``[low, high)``."""
    if value not in df.columns:
        warnings.warn(f"{value} not found; range filter skipped")
        return df
    return _mask(df, in_half_open(value, low, high), variables)


def drop_missing(df: DataFrame, value: str = "value") -> DataFrame:
    require(df, value)
    return df.where(F.col(value).isNotNull())
