"""Queries over the star-schema tables: each operator and run on whole tables.

Every query takes a session and the folder of the tables. Dates and times are
returned as text and floating-point results with six decimals.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridverify.functions.calendar import hour_start
from gridverify.functions.names import member_id
from gridverify.functions.values import to_celsius
from gridverify.operators import (
    bands,
    distribution,
    grid,
    lines,
    maps,
    masks,
    metrics,
    quality,
    select,
    series,
    temporal,
)
from gridverify.plans import roles, verification
from gridverify.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

# Settings shared with the SQL forms of the queries.
SENTINEL = 50.0
EDGES = (0.0, 500.0, 1000.0, 2000.0, 5000.0)
WEATHER_TYPES = (1, 2)
MEMBERS = ("02", "05", "07")
TIME_FROM, TIME_TO = "1995-03", "2001-06-15"
LAT_BOUNDS, LON_BOUNDS = (46.25, 1e9), (10.25, 12.0)
WET, LOW, HIGH = 5.0, 10.0, 40.0
BUCKETS = 16
LINES = {
    "alt_bin_ranges": [[0, 2000], [1000, 6000]],
    "ensemble_members": ["02", "03", "mean"],
    "include_reference": True,
}
MEMBER_LINES = {
    "enabled": True,
    "alt_bin_ranges": [[0, 2000], [1000, 6000]],
    "ensemble_members": ["all", ["02", "05"]],
}
PLOT = {
    "enabled": True,
    "spatial_map": {"enabled": True, "metric": "RMSE"},
    "time_series": {**MEMBER_LINES, "show_trend": True},
    "cycle": {"enabled": True, **LINES, "cycle_type": "monthly"},
    "distribution": {**MEMBER_LINES, "kind": "hist", "bins": 20, "reduce_dims": ["time"]},
    "member_subplots": {"enabled": True, "metric": "MAE"},
    "altitude_bin_subplots": {"enabled": True, "metric": "MAE"},
}
# Reference grid of the regridding runs, shifted against the forecast's.
SHIFTED = (46.15, 10.125)

_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _presented(function(spark, sf_dir))

    _QUERIES[function.__name__] = run
    return run


def _presented(df: DataFrame) -> DataFrame:
    """Dates and times as text, doubles rounded (adding 0 turns -0 into 0)."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampNTZType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6) + F.lit(0.0)
        columns.append(c.alias(f.name))
    return df.select(*columns)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _folder(spark: SparkSession) -> str:
    """A new folder for the tables that a query saves and reads again, where all executors reach it.

    That is below the checkpoint folder, whatever its scheme, as Spark itself asks for one that all
    executors share; a session without one has its warehouse, or a folder of this machine
    if it runs in one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        alone = spark.sparkContext.master.split("[")[0] == "local"
        base = tempfile.mkdtemp(prefix="saved-") if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/saved-{uuid.uuid4().hex}"


# --- aggregation in time ---------------------------------------------------------


def _register_periods() -> None:
    for period in ("daily", "monthly", "seasonal", "yearly"):
        for method in ("sum", "mean"):

            def run(spark, sf_dir, period=period, method=method):
                return temporal.aggregate_time(
                    roles.everything(spark, sf_dir), period, method=method
                )

            run.__name__ = f"agg_{period}_{method}"
            _query(run)


_register_periods()


@_query
def agg_none(spark, sf_dir):
    return temporal.aggregate_time(
        roles.everything(spark, sf_dir), "none", missing_value=SENTINEL
    )


@_query
def agg_monthly_min_count(spark, sf_dir):
    data = roles.everything(spark, sf_dir)
    return temporal.aggregate_time(data, "monthly", missing_value=SENTINEL, min_count=1)


@_query
def ensemble_mean_daily(spark, sf_dir):
    return temporal.aggregate_time(
        roles.ensemble(spark, sf_dir), "daily", compute_ens_mean=True
    )


@_query
def ensemble_mean_hourly_data(spark, sf_dir):
    return temporal.aggregate_time(
        roles.hourly(spark, sf_dir), "daily", method="mean", compute_ens_mean=True
    )


@_query
def weather_group_mean(spark, sf_dir):
    return temporal.weather_type_mean(
        roles.everything(spark, sf_dir), roles.weather(spark, sf_dir)
    )


# --- selections --------------------------------------------------------------------


@_query
def included_days(spark, sf_dir):
    return select.included_days(roles.weather(spark, sf_dir), WEATHER_TYPES)


@_query
def weather_filter(spark, sf_dir):
    return select.filter_weather(
        roles.everything(spark, sf_dir), roles.weather(spark, sf_dir), WEATHER_TYPES
    )


@_query
def time_slice(spark, sf_dir):
    return select.slice_time(roles.everything(spark, sf_dir), TIME_FROM, TIME_TO)


@_query
def member_select(spark, sf_dir):
    return select.select_members(roles.everything(spark, sf_dir), MEMBERS)


@_query
def bbox_subset(spark, sf_dir):
    return select.subset_box(
        roles.everything(spark, sf_dir), roles.cells(spark, sf_dir), LAT_BOUNDS, LON_BOUNDS
    )


@_query
def bbox_cells(spark, sf_dir):
    """A terrain-shaped region: the enclosing box keeps its other cells as NULL."""
    region = roles.terrain(spark, sf_dir).withColumn("lon", F.lit(11.0))
    data = maps.time_map(roles.everything(spark, sf_dir))
    return select.subset_box(data, region, (0, 3000), (10, 12), lat="altitude", lon="lon")


# --- repairs and masks -------------------------------------------------------------


@_query
def sentinel_fix(spark, sf_dir):
    return masks.clean_values(roles.everything(spark, sf_dir), missing_value=SENTINEL)


@_query
def scale_factor(spark, sf_dir):
    return masks.rescale(roles.everything(spark, sf_dir), 0.1)


@_query
def unit_celsius(spark, sf_dir):
    units = (
        F.when(F.col("event_type") == "view", "K")
        .when(F.col("event_type") == "purchase", "Kelvin")
        .when(F.col("event_type") == "click", "degC")
        .when(F.col("event_type") == "signup", "mm")
        .otherwise("")
    )
    return roles.table(spark, sf_dir, "events").select(
        "event_id", "event_type", to_celsius("value", units).alias("value")
    )


@_query
def wet_filter_daily(spark, sf_dir):
    wet = masks.wet_filter(roles.everything(spark, sf_dir), WET)
    return temporal.aggregate_time(wet, "daily")


@_query
def wet_filter_zero(spark, sf_dir):
    wet = masks.wet_filter(_with_gaps(spark, sf_dir), WET, mask_as_zero=True)
    return temporal.aggregate_time(wet, "monthly", method="mean")


@_query
def range_filter(spark, sf_dir):
    ranged = masks.value_range(roles.everything(spark, sf_dir), LOW, HIGH)
    return temporal.aggregate_time(ranged, "monthly", method="mean")


@_query
def flattened_values(spark, sf_dir):
    """All values that are not missing."""
    return masks.drop_missing(_with_gaps(spark, sf_dir)).select("value")


@_query
def member_from_name(spark, sf_dir):
    name = F.concat(
        F.lit("total_"),
        F.replace(F.to_date("time").cast("string"), F.lit("-"), F.lit("")),
        F.lit("_"),
        F.col("member"),
        F.lit(".parquet"),
    )
    data = roles.everything(spark, sf_dir).select(name.alias("file_name"))
    return (
        data.select("file_name", member_id("file_name").alias("member"))
        .groupBy("file_name", "member")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


@_query
def merge_by_coords(spark, sf_dir):
    """Daily quantity by ship date and mean discount by receipt, a week later, which share some coordinates."""
    quantity = temporal.aggregate_time(roles.everything(spark, sf_dir), "daily")
    lines = roles.table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate") + F.expr("INTERVAL 7 DAYS")).alias("time"),
        F.lpad(F.col("l_linenumber").cast("string"), 2, "0").alias("member"),
        *roles.cell_index("l_suppkey"),
        F.col("l_discount").alias("value"),
    )
    discount = temporal.aggregate_time(lines, "daily", method="mean")
    return readers.merge_by_coords([quantity, discount.withColumnRenamed("value", "discount")])


@_query
def repeated_labels(spark, sf_dir):
    return readers.duplicate_labels(roles.everything(spark, sf_dir))


# --- quality -------------------------------------------------------------------------


def _with_gaps(spark, sf_dir):
    return masks.clean_values(roles.everything(spark, sf_dir), missing_value=SENTINEL)


@_query
def missing_count(spark, sf_dir):
    return quality.missing_count(_with_gaps(spark, sf_dir))


@_query
def outlier_count(spark, sf_dir):
    return quality.outlier_count(_with_gaps(spark, sf_dir), threshold=45)


@_query
def quality_report(spark, sf_dir):
    hourly = masks.clean_values(roles.hourly(spark, sf_dir))
    return verification.quality_report(_with_gaps(spark, sf_dir), hourly, threshold=40)


@_query
def profile(spark, sf_dir):
    return quality.profile(roles.everything(spark, sf_dir))


@_query
def inspect_inputs(spark, sf_dir):
    return verification.inspect(
        roles.ensemble(spark, sf_dir), roles.reference(spark, sf_dir)
    )


# --- grid ------------------------------------------------------------------------------


@_query
def axes_from_grid(spark, sf_dir):
    return grid.rectilinear(roles.rotated_cells(spark, sf_dir))


@_query
def cells_from_data(spark, sf_dir):
    located = roles.everything(spark, sf_dir).join(roles.rotated_cells(spark, sf_dir), ["iy", "ix"])
    return grid.grid_cells(located)


@_query
def dem_prepared(spark, sf_dir):
    located = roles.terrain(spark, sf_dir).join(roles.cells(spark, sf_dir), ["iy", "ix"])
    return readers.prepare_dem(
        located.withColumnRenamed("altitude", "ZH"), lat_bounds=LAT_BOUNDS, lon_bounds=LON_BOUNDS
    )


@_query
def dem_attach(spark, sf_dir):
    daily = temporal.aggregate_time(roles.hourly(spark, sf_dir), "daily")
    projected = daily.withColumn(masks.PROJECTION_COLUMN, F.lit(0))
    return grid.attach_altitude(projected, roles.terrain(spark, sf_dir))


@_query
def regrid_nearest(spark, sf_dir):
    monthly = temporal.aggregate_time(
        roles.everything(spark, sf_dir).drop("member"), "seasonal", method="mean"
    )
    return grid.regrid(
        monthly, roles.rotated_cells(spark, sf_dir), roles.fine_cells(spark, sf_dir)
    )


@_query
def regrid_bilinear(spark, sf_dir):
    mean = maps.time_map(roles.everything(spark, sf_dir).drop("member"), "mean")
    return grid.regrid(
        mean, roles.cells(spark, sf_dir), roles.fine_cells(spark, sf_dir), method="linear"
    )


@_query
def regrid_cubic(spark, sf_dir):
    mean = maps.time_map(roles.everything(spark, sf_dir).drop("member"), "mean")
    return grid.regrid(
        mean, roles.cells(spark, sf_dir), roles.fine_cells(spark, sf_dir), method="cubic"
    )


@_query
def regrid_pchip(spark, sf_dir):
    mean = maps.time_map(roles.everything(spark, sf_dir).drop("member"), "mean")
    return grid.regrid(
        mean, roles.cells(spark, sf_dir), roles.fine_cells(spark, sf_dir), method="pchip"
    )


@_query
def regrid_terrain(spark, sf_dir):
    located = roles.terrain(spark, sf_dir).join(roles.cells(spark, sf_dir), ["iy", "ix"])
    return verification.terrain_on(located, roles.fine_cells(spark, sf_dir))


# --- scores ------------------------------------------------------------------------------


def _sides(spark, sf_dir, period="monthly"):
    return (
        temporal.aggregate_time(roles.ensemble(spark, sf_dir), period),
        temporal.aggregate_time(roles.reference(spark, sf_dir), period),
    )


@_query
def bias_me_map(spark, sf_dir):
    return metrics.mean_error(*_sides(spark, sf_dir), dim=["time", "member"])


@_query
def bias_mae_map(spark, sf_dir):
    return metrics.mean_absolute_error(*_sides(spark, sf_dir), dim=["time", "member"])


@_query
def bias_rmse_map(spark, sf_dir):
    return metrics.root_mean_squared_error(*_sides(spark, sf_dir), dim="time")


@_query
def bias_scalar(spark, sf_dir):
    return metrics.all_metrics(*_sides(spark, sf_dir))


@_query
def bias_by_member(spark, sf_dir):
    return metrics.all_metrics(*_sides(spark, sf_dir, "daily"), dim=["time", "lat", "lon"])


@_query
def bias_by_season(spark, sf_dir):
    return metrics.all_metrics(*_sides(spark, sf_dir, "seasonal"), dim=["iy", "ix"])


@_query
def bias_by_year(spark, sf_dir):
    scores = metrics.all_metrics(*_sides(spark, sf_dir, "yearly"), dim=["iy", "ix", "member"])
    return metrics.to_long(scores)


def _band_errors(spark, sf_dir, period="monthly"):
    model, observed = _sides(spark, sf_dir, period)
    observed = grid.attach_altitude(observed, roles.terrain(spark, sf_dir))
    return metrics.pair(
        model, bands.mark_bands(observed, EDGES), carry=("bin_min", "bin_max")
    )


@_query
def band_bias_monthly(spark, sf_dir):
    """Monthly scores per altitude band and member: the flagship."""
    banded = _band_errors(spark, sf_dir).where("bin_min IS NOT NULL")
    return metrics.score(banded, ["time", "iy", "ix"], by=["bin_min", "bin_max"])


@_query
def band_and_domain_bias(spark, sf_dir):
    errors = _band_errors(spark, sf_dir, "seasonal")
    scores = metrics.score_with_bands(errors, ["season", "member", "iy", "ix"])
    return metrics.to_long(scores)


@_query
def band_cells(spark, sf_dir):
    """Cells and values per band."""
    daily = temporal.aggregate_time(roles.everything(spark, sf_dir), "daily")
    banded = bands.altitude_bands(
        grid.attach_altitude(daily, roles.terrain(spark, sf_dir)), EDGES
    )
    return banded.groupBy("bin_min", "bin_max").agg(
        F.count_distinct("iy", "ix").alias("n_cells"),
        F.count("value").alias("n_values"),
        F.sum("value").alias("total"),
    )


# --- maps ------------------------------------------------------------------------------------


@_query
def time_sum_map(spark, sf_dir):
    return maps.time_map(roles.everything(spark, sf_dir))


@_query
def time_mean_map(spark, sf_dir):
    return maps.time_map(roles.hourly(spark, sf_dir), "mean")


@_query
def map_difference(spark, sf_dir):
    observed = maps.time_map(roles.reference(spark, sf_dir))
    return maps.map_difference(maps.time_map(roles.ensemble(spark, sf_dir)), observed)


@_query
def member_panels(spark, sf_dir):
    scores = metrics.all_metrics(*_sides(spark, sf_dir), dim="time")
    return maps.member_panels(scores, "MAE")


@_query
def single_map(spark, sf_dir):
    model, observed = _sides(spark, sf_dir)
    scores = metrics.all_metrics(temporal.ensemble_mean(model), observed, dim="time")
    return maps.single_map(scores, "RMSE")


@_query
def band_panels(spark, sf_dir):
    maes = metrics.mean_absolute_error(*_sides(spark, sf_dir), dim="time")
    banded = bands.altitude_bands(
        grid.attach_altitude(maes, roles.terrain(spark, sf_dir)), EDGES
    )
    return maps.band_panels(banded, "MAE")


# --- series and cycles --------------------------------------------------------------------------


@_query
def area_mean_series(spark, sf_dir):
    daily = temporal.aggregate_time(roles.everything(spark, sf_dir), "daily")
    return series.area_mean(daily)


@_query
def grid_row_series(spark, sf_dir):
    """Mean over the grid columns only: one series per grid row and member."""
    monthly = temporal.aggregate_time(roles.everything(spark, sf_dir), "monthly")
    return series.area_mean(monthly, reduce_dims=["lon_coord"])


@_query
def series_trend(spark, sf_dir):
    monthly = temporal.aggregate_time(roles.everything(spark, sf_dir), "monthly")
    return series.add_trend(series.area_mean(monthly), by=["member"])


def _hourly_series(spark, sf_dir):
    hourly = roles.hourly(spark, sf_dir).withColumn("time", hour_start("time"))
    return series.area_mean(hourly)


@_query
def cycle_diurnal(spark, sf_dir):
    return series.mean_cycle(_hourly_series(spark, sf_dir), "diurnal")


def _register_cycles() -> None:
    for cycle in ("daily", "monthly", "seasonal", "annual"):

        def run(spark, sf_dir, cycle=cycle):
            daily = temporal.aggregate_time(roles.everything(spark, sf_dir), "daily")
            return series.mean_cycle(series.area_mean(daily), cycle)

        run.__name__ = f"cycle_{cycle}"
        _query(run)


_register_cycles()


def _line_inputs(spark, sf_dir, period="monthly"):
    high = roles.terrain(spark, sf_dir)
    return [grid.attach_altitude(side, high) for side in _sides(spark, sf_dir, period)]


@_query
def spec_lines(spark, sf_dir):
    rows = lines.line_values(*_line_inputs(spark, sf_dir), lines.build_lines(LINES))
    return rows.groupBy("line", "source", "member").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("value").alias("total")
    )


@_query
def line_series(spark, sf_dir):
    found = series.line_series(*_line_inputs(spark, sf_dir), lines.build_lines(LINES))
    return series.add_trend(found)


@_query
def line_cycle(spark, sf_dir):
    return series.line_cycle(
        *_line_inputs(spark, sf_dir), lines.build_cycle_lines(LINES), "monthly"
    )


# --- distributions ---------------------------------------------------------------------------------


def _banded_values(spark, sf_dir):
    monthly = temporal.aggregate_time(roles.everything(spark, sf_dir), "monthly")
    return bands.altitude_bands(
        grid.attach_altitude(monthly, roles.terrain(spark, sf_dir)), EDGES
    )


@_query
def hist_by_band(spark, sf_dir):
    return distribution.histogram(
        _banded_values(spark, sf_dir), ["bin_min", "bin_max"], bins=30
    )


@_query
def hist_by_cell(spark, sf_dir):
    return distribution.histogram(roles.hourly(spark, sf_dir), ["iy", "ix"], bins=10)


@_query
def hist_all(spark, sf_dir):
    return distribution.histogram(roles.hourly(spark, sf_dir), bins=50)


@_query
def kde_by_band(spark, sf_dir):
    return distribution.density_curve(_banded_values(spark, sf_dir), ["bin_min", "bin_max"])


@_query
def kde_by_member(spark, sf_dir):
    return distribution.density_curve(roles.hourly(spark, sf_dir), ["member"])


@_query
def line_histograms(spark, sf_dir):
    return distribution.line_distribution(
        *_line_inputs(spark, sf_dir), lines.build_lines(LINES), "hist", bins=20
    )


@_query
def line_densities(spark, sf_dir):
    return distribution.line_distribution(
        *_line_inputs(spark, sf_dir, "yearly"), lines.build_lines(LINES), "kde"
    )


# --- runs ----------------------------------------------------------------------------------------------


@_query
def preprocess(spark, sf_dir):
    daily, rescaled = verification.preprocess(
        roles.ensemble(spark, sf_dir), roles.reference(spark, sf_dir), 0.1
    )
    rescaled = rescaled.withColumns({
        "time": F.to_date("time"), "member": F.lit("reference")
    })
    return daily.unionByName(rescaled)


@_query
def minimal_run(spark, sf_dir):
    return verification.minimal_run(
        roles.ensemble(spark, sf_dir),
        roles.reference(spark, sf_dir),
        ensemble_cells=roles.cells(spark, sf_dir),
        reference_cells=roles.cells(spark, sf_dir, *SHIFTED),
    )


@_query
def verification_run(spark, sf_dir):
    return verification.verify(
        roles.ensemble(spark, sf_dir),
        roles.reference(spark, sf_dir),
        verification.Selection(period="monthly", missing_value=SENTINEL),
        ensemble_cells=roles.cells(spark, sf_dir),
        reference_cells=roles.cells(spark, sf_dir, *SHIFTED),
        dem=roles.terrain(spark, sf_dir),
        edges=EDGES,
        metrics=["RMSE", "MAE", "ME"],
        collapse=["time", "lat", "lon"],
    )


@_query
def temperature_run(spark, sf_dir):
    """The values as temperatures: the forecast in Kelvin, the observation in Celsius."""
    return verification.verify(
        roles.ensemble(spark, sf_dir),
        roles.reference(spark, sf_dir),
        verification.Selection(
            variable="T2M",
            units="K",
            reference_units="degC",
            period="daily",
            method="mean",
        ),
        metrics=["ME", "RMSE"],
        collapse=["time", "lat", "lon"],
    )


@_query
def full_run(spark, sf_dir):
    return verification.verify(
        roles.ensemble(spark, sf_dir),
        roles.reference(spark, sf_dir),
        verification.Selection(
            lat_bounds=LAT_BOUNDS,
            lon_bounds=LON_BOUNDS,
            start=TIME_FROM,
            end=TIME_TO,
            members=MEMBERS,
            ensemble_mean=True,
            include_types=WEATHER_TYPES,
            wet_threshold=WET,
            value_range=(LOW, HIGH),
            period="yearly",
            missing_value=SENTINEL,
        ),
        ensemble_cells=roles.cells(spark, sf_dir),
        reference_cells=roles.cells(spark, sf_dir, *SHIFTED),
        weather=roles.weather(spark, sf_dir),
        dem=roles.terrain(spark, sf_dir),
        edges=EDGES,
        metrics=["RMSE", "MAE", "ME"],
        collapse=["time"],
    )


@_query
def band_rmse_maps(spark, sf_dir):
    return verification.band_rmse_maps(
        roles.ensemble(spark, sf_dir),
        roles.reference(spark, sf_dir),
        roles.terrain(spark, sf_dir),
        EDGES,
    )


# --- figures ---------------------------------------------------------------------------------------------


def figures(
    spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(PLOT), mean: bool = False
) -> dict[str, DataFrame]:
    """The named figures of a monthly run with its members, or of their mean."""
    model, observed = _sides(spark, sf_dir)
    return verification.figure_data(
        temporal.ensemble_mean(model) if mean else model,
        observed,
        {"enabled": True, **{name: PLOT[name] for name in names}},
        terrain=roles.terrain(spark, sf_dir),
        edges=EDGES,
        collapse=["time"],
    )


def _register_figures() -> None:
    for name in PLOT:
        if name == "enabled":
            continue

        def run(spark, sf_dir, name=name):
            return figures(spark, sf_dir, (name,), mean=name == "spatial_map")[name]

        run.__name__ = f"figure_{name}"
        _query(run)


_register_figures()


@_query
def banded_data(spark, sf_dir):
    """How many rows of both sides and of the score maps lie in each band, and their sums."""
    model, observed = _sides(spark, sf_dir)
    wide = verification.scored(model, observed, metrics=["MAE"], collapse="time")
    parts = verification.banded_data(model, observed, roles.terrain(spark, sf_dir), EDGES, wide)
    sums = [
        df.groupBy("bin_min", "bin_max").agg(
            F.lit(name).alias("part"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("MAE" if name == "maps" else "value").alias("total"),
        )
        for name, df in parts.items()
    ]
    return sums[0].union(sums[1]).union(sums[2])


# --- saved tables ---------------------------------------------------------------------------------------


@_query
def saved_months(spark, sf_dir):
    """The time slice of the forecast, from a table saved by month."""
    folder = _folder(spark)
    writers.write_grid(roles.everything(spark, sf_dir), folder)
    return readers.read_months(spark, folder, TIME_FROM, TIME_TO).drop("year", "month")


@_query
def saved_months_open(spark, sf_dir):
    """Everything up to a day: months of earlier years are found by listing the years alone."""
    folder = _folder(spark)
    writers.write_grid(roles.everything(spark, sf_dir), folder)
    return readers.read_months(spark, folder, end=TIME_TO).groupBy("year", "month", "member").agg(
        F.count("value").alias("n_values"), F.sum("value").alias("total")
    )


@_query
def saved_scores(spark, sf_dir):
    """Scores per member, saved by metric and read again."""
    folder = _folder(spark)
    scores = metrics.all_metrics(*_sides(spark, sf_dir, "daily"), dim=["time", "lat", "lon"])
    writers.write_scores(scores, folder)
    return readers.read_grid(spark, folder)


@_query
def weather_csv(spark, sf_dir):
    """Weather types written as CSV with other column names, and read as a weather table."""
    folder = _folder(spark)
    types = roles.weather(spark, sf_dir).withColumnsRenamed({"time": "day", "slwt": "gwt"})
    types.write.csv(folder, header=True)
    return readers.read_weather_types(spark, folder, date_col="day", weather_type="gwt")


@_query
def saved_cells_bias(spark, sf_dir):
    """RMSE map of monthly values, from daily tables that lie in buckets of cells."""
    folder = _folder(spark)
    names = [f"cells_{uuid.uuid4().hex}" for _ in range(2)]
    for name, df in zip(names, _sides(spark, sf_dir, "daily")):
        writers.write_cells(df, name, buckets=BUCKETS, path=f"{folder}/{name}")
    monthly = [temporal.aggregate_time(df, "monthly") for df in readers.read_cells(spark, *names)]
    return metrics.root_mean_squared_error(*monthly, dim="time")


@_query
def configured_run(spark, sf_dir):
    """A run by configuration over saved tables: slice, members, weather days, bands and saved scores."""
    folder = _folder(spark)
    cells = roles.cells(spark, sf_dir)
    tables = {"ensemble": roles.ensemble(spark, sf_dir), "reference": roles.reference(spark, sf_dir)}
    for name, df in tables.items():
        writers.write_grid(df, f"{folder}/{name}")
    cells.write.parquet(f"{folder}/cells")
    roles.terrain(spark, sf_dir).join(cells, ["iy", "ix"]).write.parquet(f"{folder}/dem")
    roles.weather(spark, sf_dir).withColumnRenamed("time", "date").write.csv(f"{folder}/types", header=True)
    verification.run_config(
        spark,
        {
            "input": {
                "ensemble_pattern": f"{folder}/ensemble", "reference_file": f"{folder}/reference", "by_month": True,
                "ensemble_cells": f"{folder}/cells", "reference_cells": f"{folder}/cells",
                "lat_name": "lat", "lon_name": "lon",
                "var_name": "value", "ref_var_name": "value", "missing_value": SENTINEL,
            },
            "subset": {"start_time": TIME_FROM, "end_time": TIME_TO},
            "ensemble": {"members": list(MEMBERS)},
            "weather_types": {"file": f"{folder}/types", "include": list(WEATHER_TYPES)},
            "aggregation": {"period": "monthly"},
            "bias": {"metrics": ["ME", "MAE", "RMSE"], "dimensions": ["time", "lat", "lon"]},
            "dem": {"enabled": True, "dem_path": f"{folder}/dem", "dem_var": "altitude", "bins": list(EDGES)},
            "altitude_binning": {"enabled": True},
            "output": {"save_scores": f"{folder}/scores"},
        },
    ).release()
    return readers.read_grid(spark, f"{folder}/scores")
