"""Altitude bands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.functions.values import in_half_open
from gridverify.schema import require

# Default band edges in metres, for a bare mask and for a whole run.
MASK_EDGES = (0, 500, 1000, 2000)
RUN_EDGES = (0, 500, 1000, 1500, 2000, 3000)


def band_of(altitude: str | Column, edges: Sequence[float]) -> tuple[Column, Column]:
    """Lower and upper edge of the band ``[low, high)`` holding an altitude, else NULL."""
    if list(edges) != sorted(set(edges)) or len(edges) < 2:
        raise ValueError(f"band edges must be two or more ascending numbers, got {list(edges)}")
    pairs = list(zip(edges[:-1], edges[1:]))

    def choose(which: int) -> Column:
        first, *rest = pairs
        chain = F.when(in_half_open(altitude, *first), F.lit(float(first[which])))
        return reduce(
            lambda c, p: c.when(in_half_open(altitude, *p), F.lit(float(p[which]))), rest, chain
        )

    return choose(0), choose(1)


def mark_bands(
    df: DataFrame, edges: Sequence[float] = MASK_EDGES, *, altitude: str = "altitude"
) -> DataFrame:
    """Add ``bin_min`` and ``bin_max``, NULL for rows in no band."""
    require(df, altitude, error=KeyError)
    low, high = band_of(altitude, edges)
    return df.withColumns({"bin_min": low, "bin_max": high})


def altitude_bands(
    df: DataFrame, edges: Sequence[float] = MASK_EDGES, *, altitude: str = "altitude"
) -> DataFrame:
    """Rows in a band, with its edges: all bands in one pass over the data."""
    return mark_bands(df, edges, altitude=altitude).where(F.col("bin_min").isNotNull())
