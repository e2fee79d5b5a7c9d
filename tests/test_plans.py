"""What the physical plans must look like for large data."""

import re

import frames
import pytest
from compare import plan
from pyspark.sql import functions as F

from gridverify.operators import distribution, grid, lines, metrics, quality, reuse, select, series, temporal
from gridverify.plans import queries, roles, verification
from gridverify.schema import dimension_columns, dimension_list
from gridverify.sources import readers, writers

SF_DIR = "/root/testdata/sf0.001"


def test_filters_and_columns_reach_the_scan(spark):
    data = select.slice_time(roles.reference(spark, SF_DIR), "1996", "1997")
    text = plan(temporal.aggregate_time(data, "monthly"))
    assert "GreaterThanOrEqual(l_shipdate" in text and "LessThan(l_shipdate" in text
    assert "EqualTo(l_linenumber,1)" in text
    columns = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {
        "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"
    }


def test_aggregation_combines_before_its_only_shuffle(spark):
    text = plan(temporal.aggregate_time(roles.everything(spark, SF_DIR), "monthly"))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text


def test_regridding_does_not_shuffle_the_data(spark):
    cells, fine = roles.cells(spark, SF_DIR), roles.fine_cells(spark, SF_DIR)
    data = roles.everything(spark, SF_DIR)
    found = plan(grid.regrid_nearest(data, *grid.axis_maps(cells, fine)))
    # The scan of the data goes straight into two broadcast joins.
    assert found.count("BroadcastHashJoin [iy") + found.count("BroadcastHashJoin [ix") >= 2
    assert "SortMergeJoin" not in found


def test_long_axes_are_joined_by_sort_merge(spark, monkeypatch):
    monkeypatch.setattr(grid, "BROADCAST_AXIS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cells, fine = roles.cells(spark, SF_DIR), roles.fine_cells(spark, SF_DIR)
    data = roles.everything(spark, SF_DIR)
    found = grid.regrid_nearest(data, *grid.axis_maps(cells, fine))
    try:
        assert "SortMergeJoin" in plan(found) and "BroadcastHashJoin" not in plan(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    monkeypatch.undo()
    small = grid.regrid_nearest(data, *grid.axis_maps(cells, fine))
    keys = lambda d: sorted(map(str, d.collect()))
    assert keys(found) == keys(small)


def test_rows_of_few_groups_are_not_shuffled(spark):
    data = roles.hourly(spark, SF_DIR)
    for df in (distribution.histogram(data, ["member"]), distribution.density_curve(data, ["member"])):
        joined = re.search(r"BroadcastHashJoin \[coalesce\(member", plan(df))
        assert joined and "SortMergeJoin" not in plan(df)
        # Below the join with the parameters the rows come straight from the scan.
        assert "Exchange" not in plan(df)[joined.start():].split("BroadcastExchange")[0]


def test_weather_means_do_not_shuffle_by_day(spark, monkeypatch):
    data, weather = roles.everything(spark, SF_DIR), roles.weather(spark, SF_DIR)
    found = temporal.weather_type_mean(data, weather)
    assert not re.search(r"hashpartitioning\(day#\d+, \d", plan(found))
    rows = sorted(map(str, found.collect()))
    monkeypatch.setattr(temporal, "BROADCAST_DAYS", 0)
    spread = temporal.weather_type_mean(data, weather)
    assert "_part" in plan(spread) and sorted(map(str, spread.collect())) == rows


def test_cells_may_be_too_many_to_broadcast(spark, monkeypatch):
    size = lambda limit: [monkeypatch.setattr(grid, "BROADCAST_CELLS", limit), queries.queries()["full_run"](spark, SF_DIR)][1]
    assert sorted(map(str, size(0).collect())) == sorted(map(str, size(1_000_000).collect()))


@pytest.mark.parametrize("name, actions", [("full_run", 1), ("verification_run", 1), ("temperature_run", 0)])
def test_planning_a_run_takes_one_job(spark, monkeypatch, name, actions):
    done, kind = [], type(spark.range(0))
    for action in ("collect", "count", "first", "take", "head", "checkpoint", "toLocalIterator"):
        real = getattr(kind, action)
        monkeypatch.setattr(kind, action, lambda self, *a, real=real, action=action, **k: [done.append(action), real(self, *a, **k)][1])
    queries.queries()[name](spark, SF_DIR)
    assert len(done) == actions


def test_cell_tables_from_the_data_are_read_once(spark):
    spark.catalog.clearCache()
    located = roles.everything(spark, SF_DIR).join(roles.cells(spark, SF_DIR), ["iy", "ix"])
    cells = grid.grid_cells(located)
    held = []
    found = verification.verify(
        roles.ensemble(spark, SF_DIR), roles.reference(spark, SF_DIR), ensemble_cells=cells,
        reference_cells=roles.cells(spark, SF_DIR, *queries.SHIFTED), held=held,
    )
    assert len(held) == 2 and all(df.is_cached for df in held)
    shown = plan(found)
    # Both sides' own scans; the cells come from the cached table.
    assert "InMemoryTableScan" in shown
    for df in held:
        df.unpersist()
    again = verification.verify(
        roles.ensemble(spark, SF_DIR), roles.reference(spark, SF_DIR), ensemble_cells=cells.persist(),
        reference_cells=roles.cells(spark, SF_DIR, *queries.SHIFTED), held=held[2:],
    )
    # A table that was cached already is not the run's to give up.
    assert cells.is_cached and again.count() == found.count()
    spark.catalog.clearCache()


def test_figures_pair_the_two_sides_once(spark, monkeypatch):
    pairings = []
    monkeypatch.setattr(verification, "pair", lambda *a, **k: [pairings.append(1), metrics.pair(*a, **k)][1])
    figures = queries.figures(spark, SF_DIR)
    assert set(figures) == {"spatial_map", "time_series", "cycle", "distribution", "member_subplots", "altitude_bin_subplots"}
    assert len(pairings) == 1
    for name in ("member_subplots", "altitude_bin_subplots"):
        assert "FileScan parquet" not in plan(figures[name]) or name == "altitude_bin_subplots"


def test_one_figure_makes_no_scores_for_others(spark, monkeypatch):
    monkeypatch.setattr(verification, "pair", lambda *a, **k: pytest.fail("paired"))
    assert set(queries.figures(spark, SF_DIR, ("time_series",))) == {"time_series"}


def test_tables_in_buckets_of_cells_are_scored_without_a_shuffle(spark, tmp_path):
    """Aggregated further, joined by sort-merge and scored per cell; the values with a third on one cell."""
    hot = spark.range(6000).select(
        F.expr("timestamp_ntz'2017-01-01 00:00:00' + make_dt_interval(int(id % 400), int(id % 24))").alias("time"),
        F.lpad((F.col("id") % 3).cast("string"), 2, "0").alias("member"),
        F.lit(0).alias("iy"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).cast("int").alias("ix"),
        (F.col("id") % 31).cast("double").alias("value"),
    )
    daily = [temporal.aggregate_time(hot, "daily"), temporal.aggregate_time(hot.drop("member"), "daily")]
    for k, df in enumerate(daily):
        writers.write_cells(df, f"plan_cells_{k}", buckets=5, path=str(tmp_path / str(k)))
    try:
        saved = readers.read_cells(spark, "plan_cells_0", "plan_cells_1")
        def scores(sides):
            monthly = [temporal.aggregate_time(df, "monthly") for df in sides]
            model, observed = monthly[0], monthly[1].hint("merge")
            return metrics.score(metrics.pair(model, observed), "time")

        shown = plan(scores(saved))
        assert "SortMergeJoin" in shown and "Exchange" not in shown and shown.count("Bucketed: true") == 2
        assert "Exchange" in plan(scores(daily))
        assert sorted(map(str, scores(saved).collect())) == sorted(map(str, scores(daily).collect()))
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
        # Whatever was measured on the hot cell, its bucket holds a row per day and member.
        most = saved[0].groupBy("iy", "ix").count().agg(F.max("count")).first()[0]
        assert most <= 400 * 3 and saved[0].count() == daily[0].count()
        assert len(list((tmp_path / "0").glob("*.parquet"))) <= 5
    finally:
        for k in range(2):
            spark.sql(f"DROP TABLE IF EXISTS plan_cells_{k}")


def test_reuse_takes_shared_folders_only(spark, monkeypatch):
    class Session:
        def __init__(self, folder, master):
            self.conf, self.sparkContext = {"spark.checkpoint.dir": folder}, type("C", (), {"master": master})

    shared = lambda folder, master: reuse.shared_folder(Session(folder, master))
    assert shared("/tmp/x", "local[4]") and shared("file:///tmp/x", "local-cluster[3,2,1000]")
    assert not shared("/tmp/x", "spark://host:7077") and not shared("file:/tmp/x", "yarn")
    assert shared("hdfs://name/x", "yarn") and not shared(None, "local")


def test_saved_tables_lie_where_all_executors_reach_them(spark, monkeypatch, tmp_path):
    class Session:
        def __init__(self, master, **conf):
            self.conf = {f"spark.{k}": v for k, v in conf.items()}
            self.conf["spark.sql.warehouse.dir"] = "file:/shared/tables"
            self.sparkContext = type("C", (), {"master": master})

    folder = lambda *a, **b: queries._folder(Session(*a, **b)).rpartition("/saved-")[0]
    for master in ("local[4]", "local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        assert folder(master, **{"checkpoint.dir": "file:///shared/kept/"}) == "file:///shared/kept"
        assert folder(master, **{"checkpoint.dir": "hdfs://name/kept"}) == "hdfs://name/kept"
    for master in ("local-cluster[3,2,1000]", "spark://host:7077", "yarn"):
        assert folder(master) == "file:/shared/tables"
    monkeypatch.setattr(queries.tempfile, "mkdtemp", lambda prefix: str(tmp_path / prefix))
    assert folder("local") == folder("local[4]") == str(tmp_path / "saved-")

    # A session of another master saves rows and reads them again.
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda self: "spark://host:7077"), raising=False)
    rows = frames.reference(spark, [("2017-10-01", 0, 0, 1.0), ("2017-11-30", 0, 1, 2.0), ("2018-01-01", 0, 0, 4.0)])
    path = queries._folder(spark)
    writers.write_grid(rows, path)
    found = readers.read_months(spark, path, "2017-11", "2018-01").drop("year", "month")
    assert sorted(r.value for r in found.collect()) == [2.0, 4.0]


def test_profile_copies_no_rows(spark):
    assert "Expand" not in plan(quality.profile(roles.everything(spark, SF_DIR)))
    formatted = spark._jvm.PythonSQLUtils.explainString(quality.profile(roles.everything(spark, SF_DIR))._jdf.queryExecution(), "formatted")
    assert "Expand" not in formatted and formatted.count("Batched: ") == 4


def test_lines_with_several_reduced_dimensions_read_each_side_once(spark):
    sides = roles.ensemble(spark, SF_DIR), roles.reference(spark, SF_DIR)
    config = [("a", "ensemble", ["time"]), ("b", "ensemble", ["lat", "lon"]), ("c", "reference", ["time", "lon"]), ("a", "ensemble", ["member", "time"])]
    built = [lines.Line(label, source, reduce_dims=tuple(dims)) for label, source, dims in config]
    found = series.line_series(*sides, built)
    assert plan(found).count("FileScan") == 2
    rows = {}
    for r in found.collect():
        rows.setdefault((r.line, r.source, r.time is None, r.member is None, r.iy is None, r.ix is None), []).append(r.value)
    for (label, source, dims), side in zip(config, (sides[0], sides[0], sides[1], sides[0])):
        kept = [d for d in dimension_columns(side) if d not in dimension_list(dims)]
        own = sorted(r.v for r in side.groupBy(*kept).agg(F.avg("value").alias("v")).collect())
        null = tuple(d not in kept for d in ("time", "member", "iy", "ix"))
        assert sorted(rows[label, source, *null]) == pytest.approx(own)


def test_tables_of_a_run_are_released(spark, monkeypatch):
    """Without a folder for checkpoints, whatever is cached is given up with the handle."""
    monkeypatch.setattr(reuse, "shared_folder", lambda spark: None)
    manager = spark._jsparkSession.sharedState().cacheManager()
    model, weather = roles.everything(spark, SF_DIR), roles.weather(spark, SF_DIR)
    sides = roles.ensemble(spark, SF_DIR), roles.reference(spark, SF_DIR)
    built = [lines.Line("a", "ensemble"), lines.Line("b", "reference")]
    spark.catalog.clearCache()
    held = []
    temporal.weather_type_mean(model, weather, held=held).collect()
    distribution.histogram(model, ["member"], held=held).collect()
    distribution.density_curve(model, ["member"], held=held).collect()
    distribution.line_distribution(*sides, built, "hist", held=held).collect()
    assert len(held) == 4 and not manager.isEmpty()
    for df in held:
        df.unpersist()
    assert manager.isEmpty()

