"""Grid axes, regridding and terrain altitude.

A grid is a cell table ``iy, ix, lat, lon``. Regridding treats it as
rectilinear and works on the two axes on their own, so the tables it looks
things up in are as long as an axis, not as the grid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridverify.operators.masks import drop_projection
from gridverify.schema import CELL, dimension_columns, require

# If an axis of either grid has more rows than RANGE_ROWS, the search is split into
# ranges of at most 1 / AXIS_RANGES of its coordinates each.
AXIS_RANGES = 128
RANGE_ROWS = 4096

# Axis tables with at most this many rows (some tens of MB in memory) are broadcast,
# and so are tables of cells with at most this many rows.
BROADCAST_AXIS = 500_000
BROADCAST_CELLS = 1_000_000


def grid_cells(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cell table of data that carry their two-dimensional geolocation row by row."""
    require(df, *CELL, lat, lon, error=KeyError)
    return df.groupBy(*CELL).agg(F.min(lat).alias("lat"), F.min(lon).alias("lon"))


def lat_axis(cells: DataFrame, lat: str = "lat") -> DataFrame:
    """Latitude of each grid row, read in its first column."""
    require(cells, *CELL, lat, error=KeyError)
    return cells.groupBy("iy").agg(F.min_by(lat, "ix").alias("lat_coord"))


def lon_axis(cells: DataFrame, lon: str = "lon") -> DataFrame:
    """Longitude of each grid column, read in its first row."""
    require(cells, *CELL, lon, error=KeyError)
    return cells.groupBy("ix").agg(F.min_by(lon, "iy").alias("lon_coord"))


def rectilinear(cells: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Cell table with the axis coordinates in place of the two-dimensional ones."""
    joined = cells.join(lat_axis(cells, lat), "iy").join(lon_axis(cells, lon), "ix")
    return joined.drop(lat, lon)


# --- sizes --------------------------------------------------------------------


def hinted(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


@dataclass(frozen=True)
class GridSize:
    """What a plan needs to know of a grid: how many cells, how long its axes are, where to cut them.

    ``cuts`` are at most ``AXIS_RANGES + 1`` coordinates of each axis, the first
    and the last included, that cut it evenly; a short axis has only these.
    """

    cells: int
    lengths: Mapping[str, int]
    cuts: Mapping[str, list[float]]

    @property
    def axes_fit(self) -> bool:
        """Whether tables as long as an axis may be broadcast."""
        return max(self.lengths.values()) <= BROADCAST_AXIS

    @property
    def cells_fit(self) -> bool:
        """Whether a table of the cells may be broadcast."""
        return self.cells <= BROADCAST_CELLS


def _coordinates(cells: DataFrame) -> dict[str, DataFrame]:
    """Index and coordinate of each axis, as ``i, c``."""
    return {"iy": _axis(lat_axis(cells), "iy", "lat_coord"), "ix": _axis(lon_axis(cells), "ix", "lon_coord")}


def measure(grids: Mapping[str, DataFrame]) -> dict[str, GridSize]:
    """Sizes of some cell tables, by one job over all of them.

    Spark cannot tell them from the plan: its estimate for a table made by joins
    and windows is far too high, and data would then be shuffled on a grid row.
    """
    parts = []
    for name, cells in grids.items():
        parts.append(cells.select(F.lit(name).alias("name"), F.lit("cells").alias("what"), F.lit(None).cast("double").alias("c")))
        parts += [
            df.select(F.lit(name).alias("name"), F.lit(axis).alias("what"), F.col("c").cast("double").alias("c"))
            for axis, df in _coordinates(cells).items()
        ]
    shares = ", ".join(f"{k / AXIS_RANGES!r}D" for k in range(1, AXIS_RANGES))
    rows = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("name", "what")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("c").alias("first"),
            F.max("c").alias("last"),
            F.expr(f"percentile_approx(c, array({shares}))").alias("cuts"),
        )
        .collect()  # three rows per grid
    )
    found = {(r["name"], r["what"]): r for r in rows}

    def size(name: str) -> GridSize:
        n = {what: found[name, what]["n"] if (name, what) in found else 0 for what in ("cells", *CELL)}
        cuts: dict[str, list[float]] = {}
        for axis in CELL:
            r = found.get((name, axis))
            inner = r["cuts"] if n[axis] > RANGE_ROWS else []
            cuts[axis] = sorted({r["first"], *(inner or []), r["last"]}) if r and r["last"] is not None else []
        return GridSize(n["cells"], {axis: n[axis] for axis in CELL}, cuts)

    return {name: size(name) for name in grids}


# --- neighbour search on one axis --------------------------------------------


def axis_neighbours(
    source: DataFrame, target: DataFrame, bounds: Sequence[float] | None = None
) -> DataFrame:
    """Source coordinates on either side of each target coordinate.

    Both inputs have columns ``i, c`` (index, coordinate). The result has, per
    target, ``below`` (largest source coordinate < c) and ``above`` (smallest
    one >= c) as structs ``c, i``, NULL where there is none.

    Long axes are searched in ranges between ``bounds``, ascending coordinates of
    either side: range k holds what is in (bounds[k], bounds[k+1]]. A neighbour
    beyond the own range is the last source of the ranges before it, or the
    first of those after it. By default there is one range.
    """
    source = source.where("c IS NOT NULL")
    inner = list(bounds or [])[1:-1]
    if inner:
        cuts = F.expr("array(" + ", ".join(f"{b!r}D" for b in inner) + ")")
        own = F.size(F.filter(cuts, lambda b: b < F.col("c")))
    else:
        own = F.lit(0)
    source, target = (df.withColumn("range", own) for df in (source, target))
    points = source.selectExpr(
        "range", "true AS is_source", "c", "i", "struct(c, i) AS source"
    ).unionByName(target.selectExpr("range", "false AS is_source", "c", "i"), True)

    # Running neighbour from either end. At equal coordinates the targets come
    # first going up (so "below" is strict) and last going down.
    running = (W.unboundedPreceding, W.currentRow)
    upward = W.partitionBy("range").orderBy("c", "is_source").rowsBetween(*running)
    downward = (
        W.partitionBy("range").orderBy(F.desc("c"), F.desc("is_source")).rowsBetween(*running)
    )
    found = (
        points.select(
            "range",
            "i",
            "c",
            "is_source",
            F.last("source", ignorenulls=True).over(upward).alias("below"),
            F.last("source", ignorenulls=True).over(downward).alias("above"),
        )
        .where("NOT is_source")
        .drop("is_source")
    )
    if not inner:
        return found.drop("range")
    # One row per range, so at most one more than there are bounds.
    ends = source.groupBy("range").agg(
        F.min(F.struct("c", "i")).alias("first"), F.max(F.struct("c", "i")).alias("last")
    )
    every = source.sparkSession.range(len(inner) + 1).select(F.col("id").cast("int").alias("range"))
    in_order = W.partitionBy(F.lit(0)).orderBy("range")
    beyond = every.join(ends, "range", "left").select(
        "range",
        F.last("last", ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(in_order.rowsBetween(1, W.unboundedFollowing)).alias("after"),
    )
    return found.join(F.broadcast(beyond), "range").select(
        "i", "c", F.coalesce("below", "before").alias("below"), F.coalesce("above", "after").alias("above")
    )


def _in_range() -> Column:
    """Whether a target coordinate lies within the source's, ends included."""
    on_first = F.col("below").isNull() & (F.col("above.c") == F.col("c"))
    return F.col("above").isNotNull() & (F.col("below").isNotNull() | on_first)


def nearest_axis(
    source: DataFrame, target: DataFrame, bounds: Sequence[float] | None = None
) -> DataFrame:
    """Nearest source index per target index: ``target_i, source_i, inside``.

    A tie goes to the lower coordinate. Targets beyond the source's ends get
    the end next to them and ``inside`` false.
    """
    n = axis_neighbours(source, target, bounds)
    middle = F.col("below.c") / 2 + F.col("above.c") / 2
    nearest = F.when(F.col("c") <= middle, F.col("below.i")).otherwise(
        F.coalesce("above.i", "below.i")
    )
    return n.select(
        F.col("i").alias("target_i"), nearest.alias("source_i"), _in_range().alias("inside")
    )


def linear_axis(
    source: DataFrame, target: DataFrame, bounds: Sequence[float] | None = None
) -> DataFrame:
    """Weighted source indices per target index: one or two rows per target.

    Columns ``target_i, source_i, weight, corners``; ``weight`` is NULL beyond
    the source's ends. A target on the first source coordinate needs that one
    alone; elsewhere both neighbours count, also where one has weight 0.
    """
    n = axis_neighbours(source, target, bounds).withColumn("inside", _in_range())
    share = (F.col("c") - F.col("below.c")) / (F.col("above.c") - F.col("below.c"))
    single = F.col("below").isNull() | F.col("above").isNull()
    corner = lambda side, weight: F.struct(
        F.col(f"{side}.i").alias("source_i"), weight.alias("weight")
    )
    one = F.when(F.col("inside"), F.lit(1.0))
    ends = F.coalesce(F.col("below"), F.col("above"))
    corners = F.when(
        single, F.array(F.struct(ends["i"].alias("source_i"), one.alias("weight")))
    ).otherwise(F.array(corner("below", 1 - share), corner("above", share)))
    rows = n.select(F.col("i").alias("target_i"), F.explode(corners), F.size(corners).alias("corners"))
    return rows.select("target_i", "col.source_i", "col.weight", "corners")


def _axis(axis: DataFrame, index: str, coordinate: str) -> DataFrame:
    return axis.select(F.col(index).alias("i"), F.col(coordinate).alias("c"))


def axis_maps(
    source_cells: DataFrame,
    target_cells: DataFrame,
    method: str = "nearest",
    *,
    sizes: tuple[GridSize, GridSize] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Latitude and longitude maps from one grid to another.

    ``sizes`` of the two grids are measured by one small job if not given. The
    maps are marked for broadcast if the target's axes are short enough; longer
    ones are joined by sort-merge.
    """
    if method not in ("nearest", "linear"):
        raise ValueError(f"unknown regrid method {method!r}; choose 'nearest' or 'linear'")
    find = nearest_axis if method == "nearest" else linear_axis
    if sizes is None:
        sizes = tuple(measure({"source": source_cells, "target": target_cells}).values())
    source, target = (_coordinates(cells) for cells in (source_cells, target_cells))

    def one(axis: str) -> DataFrame:
        bounds = sorted({*sizes[0].cuts[axis], *sizes[1].cuts[axis]})
        split = max(size.lengths[axis] for size in sizes) > RANGE_ROWS
        return hinted(find(source[axis], target[axis], bounds if split else None), sizes[1].axes_fit)

    return one("iy"), one("ix")


# --- regridding ----------------------------------------------------------------


def _expand(df: DataFrame, lat_map: DataFrame, lon_map: DataFrame) -> DataFrame:
    """Give every row the target cells its cell feeds (``target_iy``, ``target_ix``)."""

    def side(axis_map: DataFrame, axis: str) -> DataFrame:
        rest = [c for c in axis_map.columns if c not in ("source_i", "target_i")]
        return axis_map.select(
            F.col("source_i").alias(axis),
            F.col("target_i").alias(f"target_{axis}"),
            *[F.col(c).alias(f"{c}_{axis}") for c in rest],
        )

    return df.join(side(lat_map, "iy"), "iy").join(side(lon_map, "ix"), "ix")


def regrid_nearest(
    df: DataFrame,
    lat_map: DataFrame,
    lon_map: DataFrame,
    *,
    value: str = "value",
    outside: float | None = None,
) -> DataFrame:
    """Copy each target cell's value from the nearest source cell.

    A narrow operator wherever the axis maps fit a broadcast. Target cells
    beyond the source grid get ``outside``, by default NULL. Nearest copies
    values, so aggregate in time first and regrid the result.
    """
    both = F.col("inside_iy") & F.col("inside_ix")
    rest = [c for c in df.columns if c not in (*CELL, value)]
    return _expand(df, lat_map, lon_map).select(
        *rest,
        F.col("target_iy").alias("iy"),
        F.col("target_ix").alias("ix"),
        F.when(both, F.col(value)).otherwise(F.lit(outside).cast("double")).alias(value),
    )


def regrid_linear(
    df: DataFrame, lat_map: DataFrame, lon_map: DataFrame, *, value: str = "value"
) -> DataFrame:
    """Bilinear interpolation; NULL if a corner is missing or the cell is beyond the grid."""
    rest = [d for d in dimension_columns(df) if d not in CELL]
    weighted = F.col("weight_iy") * F.col("weight_ix") * F.col(value)
    needed = F.col("corners_iy") * F.col("corners_ix")
    # In the order latitude then longitude, as two successive interpolations.
    return (
        _expand(df, lat_map, lon_map)
        .select(
            *rest,
            F.col("target_iy").alias("iy"),
            F.col("target_ix").alias("ix"),
            weighted.alias("part"),
            needed.alias("needed"),
        )
        .groupBy(*rest, *CELL)
        .agg(
            F.when(F.count("part") == F.max("needed"), F.sum("part")).alias(value),
        )
    )


def regrid(
    df: DataFrame,
    source_cells: DataFrame,
    target_cells: DataFrame,
    *,
    method: str = "nearest",
    value: str = "value",
) -> DataFrame:
    """Bring data from one grid to another: nearest, linear, cubic (spline with not-a-knot ends) or pchip (monotone)."""
    if method in ("cubic", "pchip"):
        from gridverify.operators import splines

        return splines.regrid_spline(df, *splines.spline_maps(source_cells, target_cells, method), method, value=value)
    maps = axis_maps(source_cells, target_cells, method)
    if method == "nearest":
        return regrid_nearest(df, *maps, value=value)
    return regrid_linear(df, *maps, value=value)


# --- terrain ---------------------------------------------------------------------


def attach_altitude(df: DataFrame, dem: DataFrame, altitude: str = "altitude") -> DataFrame:
    """Add the altitude of each row's cell; NULL where the terrain model has none.

    Spark broadcasts the terrain model if it is small enough and else joins by
    sort-merge. Attach to aggregated data, where a cell has few rows.
    """
    require(dem, *CELL, altitude, error=KeyError)
    terrain = dem.select(*CELL, altitude)
    return drop_projection(df).join(terrain, list(CELL), "left")
