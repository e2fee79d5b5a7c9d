"""Table layouts and small helpers for column names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = ("iy", "ix")
DIMENSIONS = ("time", "season", "member", "iy", "ix")

# Names a caller may use for a grid dimension, next to the column names themselves.
DIMENSION_ALIASES = {
    "lat": "iy",
    "lat_coord": "iy",
    "y": "iy",
    "lon": "ix",
    "lon_coord": "ix",
    "x": "ix",
}

ENSEMBLE = T.StructType(
    [
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("member", T.StringType()),
        T.StructField("iy", T.IntegerType()),
        T.StructField("ix", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)

REFERENCE = T.StructType([f for f in ENSEMBLE if f.name != "member"])

CELLS = T.StructType(
    [
        T.StructField("iy", T.IntegerType()),
        T.StructField("ix", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
    ]
)

DEM = T.StructType([*CELLS.fields, T.StructField("altitude", T.DoubleType())])

WEATHER = T.StructType(
    [
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("slwt", T.IntegerType()),
    ]
)


def require(df: DataFrame, *names: str, error: type[Exception] = ValueError) -> None:
    """Raise ``error`` if a column is missing from ``df``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise error(f"columns {missing} not found; available: {df.columns}")


def required(df: DataFrame, holds: DataFrame, message: str) -> DataFrame:
    """The rows of ``df``, in a query that fails if ``holds``, one boolean in one row, is not true.

    ``holds`` becomes a scalar subquery, which runs before any row of ``df`` is read
    and which the optimizer cannot prune with columns, rows or branches.
    """
    ok = F.when(F.col("holds"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return df.where(holds.toDF("holds").select(ok).scalar())


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The given names that are columns of ``df``, in the given order."""
    return [n for n in names if n in df.columns]


def dimension_columns(df: DataFrame) -> list[str]:
    return present(df, DIMENSIONS)


def value_columns(df: DataFrame) -> list[str]:
    """Columns holding data variables, i.e. everything but the dimensions."""
    return [c for c in df.columns if c not in DIMENSIONS]


def dimension_list(dims: str | Iterable[str] | None) -> list[str]:
    """Turn a dimension argument into a list of column names."""
    if dims is None:
        return []
    names = [dims] if isinstance(dims, str) else list(dims)
    return [DIMENSION_ALIASES.get(n, n) for n in names]
