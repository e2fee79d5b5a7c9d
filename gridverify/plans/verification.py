"""Verification runs: from two datasets to scores and figure data."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridverify.operators.bands import RUN_EDGES, altitude_bands, mark_bands
from gridverify.operators.distribution import HISTOGRAM_BINS, line_distribution
from gridverify.operators.grid import (
    BROADCAST_CELLS,
    GridSize,
    attach_altitude,
    axis_maps,
    grid_cells,
    hinted,
    measure,
    regrid_nearest,
)
from gridverify.operators.lines import build_cycle_lines, build_lines
from gridverify.operators.maps import band_panels, member_panels, single_map
from gridverify.operators.masks import (
    clean_values,
    is_temperature,
    unify_temperature_units,
    value_range,
    wet_filter,
)
from gridverify.operators.metrics import SCORES, pair, score, score_with_bands, to_long
from gridverify.operators.quality import OUTLIER_THRESHOLD, profile, quality_counts
from gridverify.operators.reuse import cached, reuse
from gridverify.operators.select import (
    crop_to_box,
    filter_weather,
    mark_bounds,
    select_members,
    slice_time,
)
from gridverify.operators.series import add_trend, line_cycle, line_series
from gridverify.operators.temporal import aggregate_time, ensemble_mean
from gridverify.functions.calendar import period_label
from gridverify.schema import CELL, present, require
from gridverify.sources.readers import prepare_dem, read_ensemble, read_grid, read_months, read_weather_types
from gridverify.sources.writers import write_grid, write_scores

# Fixed value: sentinel for missing data in the usual inputs.
MISSING_VALUE = -999


@dataclass(frozen=True)
class Selection:
    """What to take from both datasets, and how to prepare it.

    ``variable`` is the name of the forecast variable: a temperature is brought
    to Celsius, from the units given or those in the column metadata.
    """

    lat_bounds: Sequence[float] | None = None
    lon_bounds: Sequence[float] | None = None
    start: str | None = None
    end: str | None = None
    members: Sequence[str] | None = None
    check_members: bool = True
    ensemble_mean: bool = False
    include_types: Sequence[int | str] | None = None
    variable: str = "precipitation"
    units: str | None = None
    reference_units: str | None = None
    wet_threshold: float | None = None
    mask_as_zero: bool = False
    value_range: tuple[float, float] | None = None
    period: str = "daily"
    method: str = "sum"
    min_count: int = 0
    missing_value: float | None = MISSING_VALUE


def _empty_value(s: Selection) -> float | None:
    """What a period without a single value aggregates to."""
    sums = s.method == "sum" and s.min_count == 0 and period_label(s.period) is not None
    return 0.0 if sums else None


def _cropped(cells: DataFrame | None, s: Selection) -> DataFrame | None:
    """The cell table of the cropped grid, with ``in_bounds`` if there is a crop."""
    if s.lat_bounds is None or s.lon_bounds is None:
        return cells
    if cells is None:
        raise ValueError("a latitude/longitude crop needs the cell table of the grid")
    marked = mark_bounds(cells, s.lat_bounds, s.lon_bounds)
    return crop_to_box(marked, marked, fits=False)


def _side(
    df: DataFrame,
    cells: DataFrame | None,
    size: GridSize | None,
    s: Selection,
    weather: DataFrame | None,
    units: str | None,
) -> DataFrame:
    """Select, mask and aggregate one dataset on its own grid, given by its cropped cell table.

    The crop drops rows before anything else; cells of the box that lie outside
    the bounds are blanked after the aggregation, when a cell has few rows.
    """
    df = clean_values(df, missing_value=s.missing_value)
    df = slice_time(df, s.start, s.end)
    crop = s.lat_bounds is not None and s.lon_bounds is not None
    if crop:
        for axis in CELL:
            wanted = cells.select(axis).distinct()
            df = df.join(hinted(wanted, size.axes_fit), axis, "left_semi")
    if "member" in df.columns:
        df = select_members(df, s.members, check=s.check_members)
    if weather is not None:
        df = filter_weather(df, weather, s.include_types)
    if s.ensemble_mean:
        df = ensemble_mean(df)
    if is_temperature(s.variable):
        df = unify_temperature_units(df, units=units)
    if s.wet_threshold is not None:
        df = wet_filter(df, s.wet_threshold, variables=["value"], mask_as_zero=s.mask_as_zero)
    if s.value_range is not None:
        df = value_range(df, *s.value_range, variables=["value"])
    df = aggregate_time(df, s.period, method=s.method, min_count=s.min_count)
    if crop:
        blank = F.lit(_empty_value(s)).cast("double")
        flags = hinted(cells.select(*CELL, "in_bounds"), size.cells_fit)
        df = df.join(flags, list(CELL))
        df = df.withColumn("value", F.when(F.col("in_bounds"), F.col("value")).otherwise(blank))
        df = df.drop("in_bounds")
    return df


@dataclass
class Prepared:
    """Both datasets, and the cell tables and sizes of their cropped grids by name."""

    ensemble: DataFrame
    reference: DataFrame
    grids: dict[str, DataFrame]
    sizes: dict[str, GridSize]


def prepare(
    ensemble: DataFrame,
    reference: DataFrame,
    selection: Selection = Selection(),
    *,
    ensemble_cells: DataFrame | None = None,
    reference_cells: DataFrame | None = None,
    weather: DataFrame | None = None,
    value: str = "value",
    reference_value: str = "value",
    dem: DataFrame | None = None,
    held: list[DataFrame] | None = None,
) -> Prepared:
    """Both datasets selected, aggregated in time and on the reference grid.

    Without cell tables the two are taken to share a grid. Nearest-neighbour
    regridding copies values, so it commutes with the masks and the
    aggregation; it runs last, on the fewest rows.

    The cropped cell tables, and with ``dem`` the terrain model's, are cached and
    measured by one job; that is the only one that planning needs. ``held`` gets
    the cached tables, to be unpersisted when the results have been used.
    """

    def named(df: DataFrame, name: str) -> DataFrame:
        kept = present(df, ("time", "member", *CELL, "year", "month"))
        return df.select(*kept, F.col(name).alias("value"))

    s = selection
    grids = {"ensemble": _cropped(ensemble_cells, s), "reference": _cropped(reference_cells, s)}
    if dem is not None:
        grids["dem"] = dem.select(*CELL, "lat", "lon")
    grids = {name: cached(cells, held) for name, cells in grids.items() if cells is not None}
    both = {"ensemble", "reference"} <= set(grids)
    needed = both or "dem" in grids or s.lat_bounds is not None and s.lon_bounds is not None
    sizes = measure(grids) if grids and needed else {}
    sides = (
        ("ensemble", named(ensemble, value), s.units),
        ("reference", named(reference, reference_value), s.reference_units),
    )
    ens, ref = (
        _side(df, grids.get(name), sizes.get(name), s, weather, units) for name, df, units in sides
    )
    if both:
        maps = axis_maps(
            grids["ensemble"], grids["reference"], sizes=(sizes["ensemble"], sizes["reference"])
        )
        ens = regrid_nearest(ens, *maps, outside=_empty_value(s))
    return Prepared(ens, ref, grids, sizes)


def terrain_on(
    dem: DataFrame,
    target_cells: DataFrame,
    *,
    lat: str = "lat",
    lon: str = "lon",
    sizes: tuple[GridSize, GridSize] | None = None,
) -> DataFrame:
    """Altitude of each target cell, from the nearest cell of the terrain model."""
    cells = dem.select(*CELL, F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    maps = axis_maps(cells, target_cells, sizes=sizes)
    return regrid_nearest(dem.select(*CELL, "altitude"), *maps, value="altitude")


def score_run(
    ensemble: DataFrame,
    reference: DataFrame,
    *,
    terrain: DataFrame | None = None,
    edges: Sequence[float] | None = None,
    metrics: Sequence[str] = tuple(SCORES),
    collapse: str | Sequence[str] | None = None,
) -> DataFrame:
    """Scores of prepared data in long form, domain-wide and, with edges, per band."""
    wide = scored(ensemble, reference, terrain=terrain, edges=edges, metrics=metrics, collapse=collapse)
    return to_long(wide, metrics)


def scored(
    ensemble: DataFrame,
    reference: DataFrame,
    *,
    terrain: DataFrame | None = None,
    edges: Sequence[float] | None = None,
    metrics: Sequence[str] = tuple(SCORES),
    collapse: str | Sequence[str] | None = None,
) -> DataFrame:
    """All metrics from one pairing, a column each; NULL ``bin_min`` marks the domain's rows.

    The band of a cell is looked up for the reference, which has fewer rows
    than the ensemble, and reaches the errors with it.
    """
    if edges is None:
        return score(pair(ensemble, reference), collapse, metrics=metrics)
    if terrain is None:
        raise ValueError("altitude bands need a terrain model")
    banded = mark_bands(attach_altitude(reference.drop("altitude"), terrain), edges)
    errors = pair(ensemble, banded, carry=("bin_min", "bin_max"))
    return score_with_bands(errors, collapse, metrics=metrics)


def domain_scores(wide: DataFrame) -> DataFrame:
    """The rows of ``scored`` that are the whole domain's."""
    if "bin_min" not in wide.columns:
        return wide
    return wide.where("bin_min IS NULL").drop("bin_min", "bin_max")


def verify(
    ensemble: DataFrame,
    reference: DataFrame,
    selection: Selection = Selection(),
    *,
    ensemble_cells: DataFrame | None = None,
    reference_cells: DataFrame | None = None,
    weather: DataFrame | None = None,
    dem: DataFrame | None = None,
    regrid_dem: bool = False,
    edges: Sequence[float] | None = None,
    metrics: Sequence[str] = ("RMSE",),
    collapse: str | Sequence[str] | None = None,
    value: str = "value",
    reference_value: str = "value",
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """A whole verification run: columns ``metric, <kept dimensions>, bin_min, bin_max, score``.

    Planning runs one job, over the cell tables. ``held``: see ``prepare``.
    """
    regridded = dem is not None and regrid_dem
    if regridded and reference_cells is None:
        raise ValueError("regridding the terrain model needs the reference's cell table")
    found = prepare(
        ensemble,
        reference,
        selection,
        ensemble_cells=ensemble_cells,
        reference_cells=reference_cells,
        weather=weather,
        value=value,
        reference_value=reference_value,
        dem=dem if regridded else None,
        held=held,
    )
    terrain = dem
    if regridded:
        sizes = (found.sizes["dem"], found.sizes["reference"])
        terrain = terrain_on(dem, found.grids["reference"], sizes=sizes)
    return score_run(
        found.ensemble, found.reference, terrain=terrain, edges=edges, metrics=metrics, collapse=collapse
    )


MAP_FIGURES = ("spatial_map", "member_subplots", "altitude_bin_subplots")


def map_metrics(plot: Mapping) -> list[str]:
    """The metrics that the enabled map figures show."""
    if not plot.get("enabled", False):
        return []
    sections = [plot.get(name, {}) for name in MAP_FIGURES]
    return sorted({c.get("metric", "RMSE") for c in sections if c.get("enabled", False)})


# --- figure data -------------------------------------------------------------------


def figure_data(
    ensemble: DataFrame,
    reference: DataFrame,
    plot: Mapping,
    *,
    terrain: DataFrame | None = None,
    edges: Sequence[float] = RUN_EDGES,
    collapse: str | Sequence[str] | None = ("time",),
    maps: DataFrame | None = None,
    held: list[DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The table behind each figure enabled in ``plot``.

    Sections: ``spatial_map``, ``time_series``, ``cycle``, ``distribution``,
    ``member_subplots`` and ``altitude_bin_subplots``. The maps share the scores
    ``maps``, which come from one pairing of the two sides if not given. ``held`` gets
    the tables that are cached for them.
    """
    if not plot.get("enabled", False):
        return {}

    def section(name: str) -> Mapping | None:
        found = plot.get(name, {})
        return found if found.get("enabled", False) else None

    metrics = map_metrics(plot)
    if metrics and maps is None:
        maps = reuse(score(pair(ensemble, reference), collapse, metrics=metrics), held)
    if terrain is not None:
        ensemble = attach_altitude(ensemble, terrain)
        reference = attach_altitude(reference, terrain)

    def metric_map(metric: str) -> DataFrame:
        return maps.drop(*[m for m in SCORES if m != metric])

    figures: dict[str, DataFrame] = {}
    if (c := section("spatial_map")) is not None:
        metric = c.get("metric", "RMSE")
        figures["spatial_map"] = single_map(metric_map(metric), metric)
    if (c := section("time_series")) is not None:
        series = line_series(ensemble, reference, build_lines(c))
        figures["time_series"] = add_trend(series) if c.get("show_trend", False) else series
    if (c := section("cycle")) is not None:
        figures["cycle"] = line_cycle(
            ensemble, reference, build_cycle_lines(c), c.get("cycle_type", "monthly")
        )
    if (c := section("distribution")) is not None:
        table = line_distribution(
            ensemble,
            reference,
            build_lines(c),
            c.get("kind", "hist"),
            bins=c.get("bins", HISTOGRAM_BINS),
            held=held,
        )
        if table is not None:
            figures["distribution"] = table
    if (c := section("member_subplots")) is not None and "member" in ensemble.columns:
        metric = c.get("metric", "RMSE")
        figures["member_subplots"] = member_panels(metric_map(metric), metric)
    if (c := section("altitude_bin_subplots")) is not None and terrain is not None:
        metric = c.get("metric", "RMSE")
        banded = altitude_bands(attach_altitude(metric_map(metric), terrain), edges)
        figures["altitude_bin_subplots"] = band_panels(banded, metric)
    return figures


# --- a run described by a configuration -------------------------------------------


@dataclass
class RunResult:
    """Scores, both datasets, the figures' tables and, with bands, what lies in each band.

    ``release`` gives up the tables that were cached for the run.
    """

    scores: DataFrame
    ensemble: DataFrame
    reference: DataFrame
    figures: dict[str, DataFrame] = field(default_factory=dict)
    banded: dict[str, DataFrame] = field(default_factory=dict)
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()
        self.held.clear()


def banded_data(
    ensemble: DataFrame,
    reference: DataFrame,
    terrain: DataFrame,
    edges: Sequence[float] = RUN_EDGES,
    maps: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Rows of the ensemble, the reference and the score maps that lie in a band, with its edges."""
    sides = {"ensemble": ensemble, "reference": reference, "maps": maps}
    return {
        name: altitude_bands(attach_altitude(df.drop("altitude"), terrain), edges)
        for name, df in sides.items()
        if df is not None and set(CELL) <= set(df.columns)
    }


def selection_from(config: Mapping) -> Selection:
    """Selection of a configuration with the sections ``input``, ``subset``, ``ensemble``,
    ``weather_types``, ``wet_filter``, ``precip_category`` and ``aggregation``."""
    inputs = config.get("input", {})
    subset = config.get("subset", {})
    members = config.get("ensemble", {})
    wet = config.get("wet_filter", {})
    category = config.get("precip_category", {})
    ranged = category.get("enabled", False)
    return Selection(
        lat_bounds=subset.get("lat_bounds"),
        lon_bounds=subset.get("lon_bounds"),
        start=subset.get("start_time"),
        end=subset.get("end_time"),
        members=members.get("members"),
        ensemble_mean=members.get("mean", False),
        include_types=config.get("weather_types", {}).get("include"),
        variable=inputs.get("var_name", "precipitation"),
        units=inputs.get("units"),
        reference_units=inputs.get("ref_units"),
        wet_threshold=wet.get("threshold", 0.1) if wet.get("enabled", False) else None,
        mask_as_zero=wet.get("mask_as_zero", False),
        value_range=(category.get("min_val", 0), category.get("max_val", 99999)) if ranged else None,
        period=config.get("aggregation", {}).get("period", "daily"),
        missing_value=inputs.get("missing_value", MISSING_VALUE),
    )


def run_config(spark: SparkSession, config: Mapping) -> RunResult:
    """Run a configuration over stored tables.

    The input tables have ``time, iy, ix`` and the variable; the ensemble's
    members come from a ``member`` column or the file names. Geolocation comes
    from the cell tables ``input.ensemble_cells`` and ``input.reference_cells``
    if given, else from latitude and longitude columns of the data, which are
    then read once more for it. With ``input.by_month`` both tables are folders by
    year and month, the ensemble's with a ``member`` column, and only the months of
    the time slice are listed.
    """
    inputs = config["input"]
    selection = selection_from(config)
    if inputs.get("by_month", False):
        span = (selection.start, selection.end)
        ensemble = read_months(spark, inputs["ensemble_pattern"], *span)
        require(ensemble, "member")
        reference = read_months(spark, inputs["reference_file"], *span)
    else:
        ensemble = read_ensemble(spark, inputs["ensemble_pattern"])
        reference = read_grid(spark, inputs["reference_file"])

    def cell_table(data: str, path: str | None, lat: str, lon: str) -> DataFrame:
        if not path:
            warnings.warn(
                "no cell table is given: all rows are read once more for their coordinates", stacklevel=3
            )
        return grid_cells(read_grid(spark, path or data), lat, lon)

    ensemble_cells = cell_table(
        inputs["ensemble_pattern"],
        inputs.get("ensemble_cells"),
        inputs.get("lat_name", "latitude"),
        inputs.get("lon_name", "longitude"),
    )
    reference_cells = cell_table(
        inputs["reference_file"],
        inputs.get("reference_cells"),
        inputs.get("ref_lat_name", "lat"),
        inputs.get("ref_lon_name", "lon"),
    )

    weather = None
    types = config.get("weather_types", {})
    if types.get("file") and types.get("include"):
        weather = read_weather_types(spark, types["file"])

    held: list[DataFrame] = []
    found = prepare(
        ensemble,
        reference,
        selection,
        ensemble_cells=ensemble_cells,
        reference_cells=reference_cells,
        weather=weather,
        held=held,
        value=inputs.get("var_name", "precipitation"),
        reference_value=inputs.get("ref_var_name", "RR"),
    )
    ens, ref = found.ensemble, found.reference

    def kept(df: DataFrame) -> DataFrame:
        return reuse(df, held)

    terrain = None
    dem_config = config.get("dem", {})
    if dem_config.get("enabled", False):
        lat, lon = dem_config.get("lat_var", "lat"), dem_config.get("lon_var", "lon")
        raw = read_grid(spark, dem_config["dem_path"])
        dem = prepare_dem(
            raw,
            dem_config.get("dem_var", "ZH"),
            lat_bounds=selection.lat_bounds,
            lon_bounds=selection.lon_bounds,
            lat=lat,
            lon=lon,
        )
        terrain = dem
        if dem_config.get("regrid_to_reference", False):
            terrain = terrain_on(dem, found.grids["reference"], lat="lat_coord", lon="lon_coord")
        # One row per cell of the reference, or else of the terrain model's own grid.
        terrain = kept(terrain.select(*CELL, "altitude"))
        terrain = hinted(terrain, terrain.count() <= BROADCAST_CELLS)

    banding = config.get("altitude_binning", {})
    edges = banding.get("bins") or dem_config.get("bins") or RUN_EDGES
    bias = config.get("bias", {})
    collapse = bias.get("dimensions")
    plot = config.get("plot", {})
    figures_wanted = plot.get("enabled", False)
    if figures_wanted and period_label(selection.period) is not None:
        # Aggregated tables only: without a period these would be copies of the raw data.
        ens, ref = kept(ens), kept(ref)
    bands = edges if banding.get("enabled", False) and terrain is not None else None
    metrics = list(bias.get("metrics", ["RMSE"]))
    every = sorted({*metrics, *map_metrics(plot)})
    wide = scored(ens, ref, terrain=terrain, edges=bands, metrics=every, collapse=collapse)
    if figures_wanted or bands is not None:
        wide = kept(wide)
    scores, maps = to_long(wide.drop(*(set(every) - set(metrics))), metrics), domain_scores(wide)
    figures = figure_data(
        ens, ref, plot, terrain=terrain, edges=edges, collapse=collapse, maps=maps, held=held
    )
    banded = banded_data(ens, ref, terrain, edges, maps) if bands is not None else {}
    if path := config.get("output", {}).get("save_scores"):
        write_scores(scores, path)
    return RunResult(scores, ens, ref, figures, banded, held)


# --- smaller runs -------------------------------------------------------------------


def minimal_run(
    ensemble: DataFrame,
    reference: DataFrame,
    *,
    missing_value: float | None = MISSING_VALUE,
    **choices,
) -> DataFrame:
    """Daily sums and the RMSE over time, per cell and member."""
    selection = Selection(missing_value=missing_value)
    found = prepare(ensemble, reference, selection, **choices)
    return score(pair(found.ensemble, found.reference), "time", metrics=["RMSE"])


def band_rmse_maps(
    ensemble: DataFrame,
    reference: DataFrame,
    terrain: DataFrame,
    edges: Sequence[float] = RUN_EDGES,
) -> DataFrame:
    """RMSE over time of the daily ensemble mean, per cell, under the cell's band."""
    ens = aggregate_time(ensemble, "daily", compute_ens_mean=True)
    ref = aggregate_time(reference, "daily")
    maps = score(pair(ens, ref), "time", metrics=["RMSE"])
    return altitude_bands(attach_altitude(maps, terrain), edges).drop("altitude")


def preprocess(
    ensemble: DataFrame,
    reference: DataFrame,
    scale_factor: float,
    *,
    ensemble_path: str | None = None,
    reference_path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Daily ensemble sums and the rescaled reference, saved if paths are given."""
    daily = aggregate_time(ensemble, "daily")
    rescaled = clean_values(reference).withColumn(
        "value", F.col("value") * F.lit(float(scale_factor))
    )
    if ensemble_path:
        write_grid(daily, ensemble_path)
    if reference_path:
        write_grid(rescaled, reference_path)
    return daily, rescaled


def quality_report(
    ensemble: DataFrame, reference: DataFrame, threshold: float = OUTLIER_THRESHOLD
) -> DataFrame:
    """Row, missing and outlier counts of both datasets."""
    parts = [
        quality_counts(df, threshold=threshold).withColumn("source", F.lit(name))
        for name, df in (("ensemble", ensemble), ("reference", reference))
    ]
    return parts[0].unionByName(parts[1])


def inspect(ensemble: DataFrame, reference: DataFrame) -> DataFrame:
    """Summary of both datasets."""
    parts = [
        profile(df, values=["value"]).withColumn("source", F.lit(name))
        for name, df in (("ensemble", ensemble), ("reference", reference))
    ]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


__all__ = [
    "Prepared",
    "RunResult",
    "Selection",
    "band_rmse_maps",
    "banded_data",
    "domain_scores",
    "figure_data",
    "inspect",
    "minimal_run",
    "prepare",
    "preprocess",
    "quality_report",
    "reuse",
    "run_config",
    "score_run",
    "scored",
    "selection_from",
    "terrain_on",
    "verify",
]
