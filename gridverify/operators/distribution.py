"""Histograms and density curves of all values of a group."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.functions.values import clean
from gridverify.operators.lines import Line
from gridverify.operators.reuse import reuse
from gridverify.operators.series import LINE_KEYS, reduced_lines
from gridverify.schema import require

# Default number of histogram bins and of points of a curve.
HISTOGRAM_BINS = 20
CURVE_POINTS = 200

# A group table with at most this many rows (a few MB) may be broadcast.
BROADCAST_GROUPS = 100_000

# In a longer one, a group with more than one in so many of all rows is heavy; there are
# at most that many heavy groups.
HEAVY_SHARE = 1000

# Beyond so many bandwidths a kernel is 0 in double precision.
KERNEL_REACH = 39

# Density curve: values are summed up in cells half a bandwidth wide, each
# described by this many moments. A value is at most 1/4 bandwidth from its
# cell's centre, and the first neglected term of the expansion is below
# 0.25**16 / sqrt(16!) = 5e-17 of a kernel's peak, less than a rounding error.
CELL_WIDTH = 0.5
MOMENTS = 16


def _with_parameters(
    rows: DataFrame, parameters: DataFrame, keys: Sequence[str], held: list[DataFrame] | None = None
) -> DataFrame:
    """Give each row its group's parameters, which include its number of rows ``_size``.

    The parameters are computed once and counted. Those of few groups are
    broadcast and the rows stay where they are. Of many groups, those of the heavy
    ones are broadcast, of which there cannot be many, and the others are joined by
    key.
    """
    if not keys:
        # One group: its parameters are scalar subqueries, there is nothing to join.
        return rows.withColumns({c: parameters.select(c).scalar() for c in parameters.columns})
    known = reuse(
        parameters.select(
            *[F.col(k).alias(f"_{k}") for k in keys],
            *[c for c in parameters.columns if c not in keys],
        ),
        held,
    )
    groups, total = known.agg(F.count(F.lit(1)), F.sum("_size")).first()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    if groups <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(known), same)
    else:
        heavy = F.col("_size") > total / HEAVY_SHARE
        often = F.broadcast(known.where(heavy))
        rest = rows.join(often, same, "left_anti").join(known.where(~heavy), same)
        joined = rows.join(often, same).unionByName(rest)
    return joined.drop(*[f"_{k}" for k in keys])


def histogram(
    df: DataFrame,
    by: Sequence[str] = (),
    *,
    bins: int = HISTOGRAM_BINS,
    value: str = "value",
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """Counts in ``bins`` equal-width bins between each group's extremes.

    Bins are half-open, the last one closed; empty bins are listed. A group
    with a single distinct value gets a range of one unit around it. ``held`` gets
    the table of the groups' extremes if it is cached; see ``reuse``.
    """
    require(df, value, *by)
    rows = df.select(*by, clean(value).alias("_v")).where("_v IS NOT NULL")
    flat = F.col("_lo") == F.col("_hi")
    limits = rows.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_size")
    )
    limits = limits.select(
        *by,
        "_size",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    step = (F.col("_hi") - F.col("_lo")) / bins

    def edge(index: Column) -> Column:
        return F.when(index == bins, F.col("_hi")).otherwise(index * step + F.col("_lo"))

    guess = F.least(
        F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins),
        F.lit(bins - 1),
    ).cast("int")
    # The quotient may be off by a rounding error next to an edge.
    at = F.col("_guess")
    settled = (
        F.when(F.col("_v") < edge(at), at - 1)
        .when((F.col("_v") >= edge(at + 1)) & (at < bins - 1), at + 1)
        .otherwise(at)
    )
    counts = (
        _with_parameters(rows, limits, by, held)
        .withColumn("_guess", guess)
        .groupBy(*by, settled.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.first("_lo").alias("_lo"),
            F.first("_hi").alias("_hi"),
        )
    )
    # At most ``bins`` counts per group come together to list the empty bins too.
    filled = counts.groupBy(*by).agg(
        F.first("_lo").alias("_lo"),
        F.first("_hi").alias("_hi"),
        F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_counts"),
    )
    if not by:
        filled = filled.where("_lo IS NOT NULL")
    every = filled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.select(
        *by,
        "bin",
        edge(F.col("bin")).alias("bin_left"),
        edge(F.col("bin") + 1).alias("bin_right"),
        F.coalesce(F.col("_counts")[F.col("bin")], F.lit(0).cast("bigint")).alias("count"),
    )


def density_curve(
    df: DataFrame,
    by: Sequence[str] = (),
    *,
    points: int = CURVE_POINTS,
    value: str = "value",
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """Gaussian kernel density of each group at ``points`` even steps over its range.

    The bandwidth is Scott's: the sample standard deviation times n**(-1/5).
    Groups with fewer than two values or no spread have no curve.

    The curve is a sum over values x points. Evaluating it term by term costs
    ``points`` exponentials per value; here the values are first reduced to
    moments in cells half a bandwidth wide (one exponential per value, combined
    in the map tasks), and the curve is summed from the cells. The series this
    uses, exp(-(d-r)**2/2) = exp(-d*d/2) * exp(-r*r/2) * sum((d*r)**k / k!), is
    the expansion behind the fast Gauss transform.
    """
    require(df, value, *by)
    rows = df.select(*by, clean(value).alias("_v")).where("_v IS NOT NULL")
    shape = (
        rows.groupBy(*by)
        .agg(
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
            F.count("_v").alias("_size"),
            F.stddev_samp("_v").alias("_sd"),
        )
        .where("_size >= 2 AND _sd > 0")
        .select(
            *by,
            "_lo",
            "_hi",
            "_size",
            (F.col("_sd") * F.pow(F.col("_size").cast("double"), F.lit(-0.2))).alias("_h"),
        )
    )
    fixed = [F.first(c).alias(c) for c in ("_lo", "_hi", "_size", "_h")]

    # Distances are in bandwidths from the group's smallest value.
    centre = (F.col("_cell") + 0.5) * CELL_WIDTH
    placed = (
        _with_parameters(rows, shape, by, held)
        .where("_h IS NOT NULL")
        .withColumn("_u", (F.col("_v") - F.col("_lo")) / F.col("_h"))
        .withColumn("_cell", F.floor(F.col("_u") / CELL_WIDTH))
        .withColumn("_r", F.col("_u") - centre)
    )
    powers = [F.exp(F.col("_r") * F.col("_r") * -0.5)]
    for _ in range(MOMENTS - 1):
        powers.append(powers[-1] * F.col("_r"))
    moments = placed.groupBy(*by, "_cell").agg(
        *fixed, *[F.sum(p).alias(f"_m{k}") for k, p in enumerate(powers)]
    )

    # What each cell adds to the points that its kernels reach, and 0 at every point.
    step = (F.col("_hi") - F.col("_lo")) / (points - 1)
    distance = F.col("point") * step / F.col("_h") - centre
    series = F.col(f"_m{MOMENTS - 1}")
    for k in range(MOMENTS - 2, -1, -1):
        series = F.col(f"_m{k}") + F.col("_d") / (k + 1) * series
    kernel = F.exp(F.col("_d") * F.col("_d") * -0.5) * series

    def reached(side: int) -> Column:
        return (centre + side * KERNEL_REACH) * F.col("_h") / step

    first = F.greatest(F.ceil(reached(-1)), F.lit(0)).cast("int")
    last = F.least(F.floor(reached(1)), F.lit(points - 1)).cast("int")
    near = F.when(first <= last, F.sequence(first, last))
    shown = [*by, "point", "_lo", "_hi", "_size", "_h"]
    added = (
        moments.withColumn("point", F.explode(near))
        .withColumn("_d", distance)
        .select(*shown, kernel.alias("_part"))
    )
    every = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    curve = (
        added.unionByName(every.select(*shown, F.lit(0.0).alias("_part")))
        .groupBy(*by, "point")
        .agg(*fixed, F.sum("_part").alias("_sum"))
    )
    x = F.when(F.col("point") == points - 1, F.col("_hi")).otherwise(
        F.col("_lo") + F.col("point") * step
    )
    norm = F.col("_size") * F.col("_h") * math.sqrt(2 * math.pi)
    return curve.select(*by, "point", x.alias("x"), (F.col("_sum") / norm).alias("density"))


def line_distribution(
    ensemble: DataFrame | None,
    reference: DataFrame | None,
    lines: Sequence[Line],
    kind: str = "hist",
    *,
    bins: int = HISTOGRAM_BINS,
    points: int = CURVE_POINTS,
    reduce_dims: Sequence[str] | str | None = None,
    held: list[DataFrame] | None = None,
    **values: str,
) -> DataFrame | None:
    """Histogram ("hist") or density curve ("kde") per line over all its values.

    ``held`` gets the table that is cached for it; see ``reuse``.
    """
    rows = reduced_lines(ensemble, reference, lines, reduce_dims, **values)
    if kind == "hist":
        return histogram(rows, LINE_KEYS, bins=bins, held=held)
    if kind == "kde":
        return density_curve(rows, LINE_KEYS, points=points, held=held)
    warnings.warn(f"unknown distribution kind {kind!r}; choose 'hist' or 'kde'")
    return None
