"""Whole runs on small tables, with results worked out by hand or in NumPy."""

import datetime as dt
import shutil

import frames
import numpy as np
import pytest
from compare import plan
from pyspark.sql import functions as F

from gridverify.operators import reuse
from gridverify.plans import verification as v
from gridverify.sources.readers import read_grid
from gridverify.sources.writers import write_grid


@pytest.fixture(scope="module")
def inputs(spark):
    """Two members, two days of six-hourly values on a 3 x 2 grid; reference on the same grid."""
    rng = np.random.default_rng(11)
    times = [f"2017-10-0{d}T{h:02}:00:00" for d in (1, 2, 3) for h in (0, 6, 12, 18)]
    ens = rng.gamma(1.0, 4.0, (len(times), 2, 3, 2)).round(2)
    ref = rng.gamma(1.0, 4.0, (len(times), 3, 2)).round(2)
    ens[0, 0, 0, 0] = -999.0
    ref[1, 2, 1] = -999.0
    ens_df = frames.ensemble(
        spark,
        [(times[t], f"0{8 + m}", y, x, float(w)) for (t, m, y, x), w in np.ndenumerate(ens)],
    )
    ref_df = frames.reference(
        spark, [(times[t], y, x, float(w)) for (t, y, x), w in np.ndenumerate(ref)]
    )
    cells = frames.cells(spark, [46, 47, 48], [10, 11])
    dem = cells.withColumn("altitude", F.col("iy") * 400.0 + F.col("ix") * 50.0)
    return ens, ref, ens_df, ref_df, cells, dem


def daily(a):
    a = np.where(a == -999, 0.0, a)
    return a.reshape(3, 4, *a.shape[1:]).sum(axis=1)


def test_scores_of_a_run(inputs):
    ens, ref, ens_df, ref_df, cells, dem = inputs
    found = v.verify(
        ens_df, ref_df, dem=dem, edges=(0, 400, 800), metrics=["RMSE", "ME"],
        collapse=["time", "lat", "lon"],
    )
    table = {(r.metric, r.member, r.bin_min): r.score for r in found.collect()}
    d = daily(ens) - daily(ref)[:, None]
    for m in range(2):
        member = f"0{8 + m}"
        assert table[("ME", member, None)] == pytest.approx(d[:, m].mean())
        assert table[("RMSE", member, None)] == pytest.approx(np.sqrt((d[:, m] ** 2).mean()))
        # Band [0, 400) is the first grid row, [400, 800) the second.
        assert table[("ME", member, 0.0)] == pytest.approx(d[:, m, 0].mean())
        assert table[("RMSE", member, 400.0)] == pytest.approx(np.sqrt((d[:, m, 1] ** 2).mean()))
    assert len(table) == 2 * 2 * 3


def test_selections_of_a_run(spark, inputs):
    ens, ref, ens_df, ref_df, cells, dem = inputs
    weather = frames.weather(
        spark, [("2017-10-01T11:00:00", 6), ("2017-10-02T11:00:00", 3), ("2017-10-03T11:00:00", 6)]
    )
    found = v.verify(
        ens_df,
        ref_df,
        v.Selection(
            lat_bounds=(47, 48), lon_bounds=(10, 10.5), start="2017-10-01", end="2017-10-02",
            members=["08", "09"], ensemble_mean=True, include_types=[6], wet_threshold=1.0,
            value_range=(0, 20),
        ),
        ensemble_cells=cells, reference_cells=cells, weather=weather, metrics=["MAE"],
        collapse="time",
    )
    table = frames.as_dict(found, ["iy", "ix"], "score")
    keep = lambda a: np.where((a >= 1) & (a < 20), a, 0.0)[:4].sum(axis=0)
    ens = np.where(ens == -999, np.nan, ens)
    ref = np.where(ref == -999, np.nan, ref)
    expected = np.abs(keep(np.nanmean(ens, axis=1)) - keep(ref))
    assert table == {
        (1, 0): pytest.approx(expected[1, 0]), (2, 0): pytest.approx(expected[2, 0])
    }


def test_cells_beyond_the_forecast_grid_count_as_dry(spark, inputs):
    _, ref, ens_df, ref_df, cells, _ = inputs
    shifted = frames.cells(spark, [46, 47, 49], [10, 11])
    found = v.verify(
        ens_df, ref_df, ensemble_cells=cells, reference_cells=shifted, metrics=["ME"],
        collapse="time",
    )
    table = frames.as_dict(found, ["member", "iy", "ix"], "score")
    assert table[("08", 2, 0)] == pytest.approx(-daily(ref)[:, 2, 0].mean())


def test_temperatures_are_brought_to_celsius(inputs):
    _, _, ens_df, ref_df, _, _ = inputs
    selection = v.Selection(variable="T2M", units="K", reference_units="degC", method="mean", period="none")
    plain = v.Selection(method="mean", period="none")
    score = lambda s: v.verify(ens_df, ref_df, s, metrics=["ME"]).first().score
    assert score(selection) == pytest.approx(score(plain) - 273.15)


def test_errors(inputs):
    _, _, ens_df, ref_df, cells, dem = inputs
    with pytest.raises(ValueError, match="cell table"):
        v.verify(ens_df, ref_df, v.Selection(lat_bounds=(46, 47), lon_bounds=(10, 11)))
    with pytest.raises(ValueError, match="terrain"):
        v.verify(ens_df, ref_df, edges=(0, 500))
    with pytest.raises(ValueError, match="season"):
        v.verify(ens_df, ref_df, v.Selection(period="seasonal"), collapse="time")


def test_smaller_runs(inputs, tmp_path, spark):
    ens, ref, ens_df, ref_df, cells, dem = inputs
    d = daily(ens) - daily(ref)[:, None]
    maps = frames.as_dict(v.minimal_run(ens_df, ref_df), ["member", "iy", "ix"], "RMSE")
    assert maps[("09", 1, 1)] == pytest.approx(np.sqrt((d[:, 1, 1, 1] ** 2).mean()))

    report = {r.source: r for r in v.quality_report(ens_df, ref_df, threshold=10).collect()}
    assert report["ensemble"].outliers == (ens > 10).sum() and report["reference"].missing == 0

    summary = {r.source: r for r in v.inspect(ens_df, ref_df).collect()}
    assert (summary["ensemble"].n_members, summary["reference"].n_members) == (2, None)
    assert summary["ensemble"].n_times == 12 and summary["reference"].n_cells == 6

    v.preprocess(
        ens_df, ref_df, 0.1,
        ensemble_path=str(tmp_path / "ens"), reference_path=str(tmp_path / "ref"),
    )
    saved = read_grid(spark, str(tmp_path / "ref"))
    assert saved.agg(F.sum("value")).first()[0] == pytest.approx(ref.sum() * 0.1)
    assert read_grid(spark, str(tmp_path / "ens")).count() == 3 * 2 * 6

    banded = v.band_rmse_maps(ens_df, ref_df, dem, (0, 400, 800))
    assert banded.count() == 4


def config(folder):
    """A configuration with every section, its tables under ``folder``."""
    spec = {"enabled": True, "alt_bin_ranges": [[0, 400], [400, 900]], "ensemble_members": ["08", "mean"]}
    return {
        "input": {
            "ensemble_pattern": f"{folder}/ens", "reference_file": f"{folder}/ref",
            "var_name": "precipitation", "ref_var_name": "RR", "missing_value": -999,
        },
        "subset": {"lat_bounds": [46, 48], "lon_bounds": [10, 11],
                   "start_time": "2017-10-01", "end_time": "2017-10-02"},
        "weather_types": {"file": f"{folder}/types.csv", "include": [1, "6"]},
        "wet_filter": {"enabled": False},
        "ensemble": {"members": ["08", "09"], "mean": False},
        "aggregation": {"period": "daily"},
        "bias": {"metrics": ["MAE", "RMSE"], "dimensions": ["time"]},
        "dem": {"enabled": True, "dem_path": f"{folder}/dem", "regrid_to_reference": True},
        "altitude_binning": {"enabled": True, "bins": [0, 400, 900]},
        "output": {"save_scores": f"{folder}/scores"},
        "plot": {
            "enabled": True,
            "time_series": {**spec, "show_trend": True},
            "cycle": {**spec, "cycle_type": "diurnal"},
            "distribution": {**spec, "kind": "hist", "bins": 5},
            "member_subplots": {"enabled": True, "metric": "MAE"},
            "altitude_bin_subplots": {"enabled": True, "metric": "MAE"},
            "spatial_map": {"enabled": False},
        },
    }


def write_tables(inputs, folder):
    _, _, ens_df, ref_df, cells, dem = inputs
    located = cells.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    ens_df.join(located, ["iy", "ix"]).withColumnRenamed("value", "precipitation").write.parquet(
        f"{folder}/ens"
    )
    ref_df.join(cells, ["iy", "ix"]).withColumnRenamed("value", "RR").write.parquet(f"{folder}/ref")
    dem.withColumnRenamed("altitude", "ZH").write.parquet(f"{folder}/dem")
    (folder / "types.csv").write_text("date,slwt\n2017-10-01 11:00:00,6\n2017-10-02 11:00:00,3\n")


def test_run_of_a_configuration(spark, inputs, tmp_path):
    ens, ref, ens_df, ref_df, *_ = inputs
    write_tables(inputs, tmp_path)
    with pytest.warns(UserWarning, match="once more"):
        result = v.run_config(spark, config(tmp_path))
    table = {
        (r.metric, r.member, r.iy, r.ix, r.bin_min): r.score for r in result.scores.collect()
    }
    # The only included day in the time slice is the first.
    expected = np.abs(daily(ens)[0] - daily(ref)[0][None])
    assert table[("MAE", "09", 2, 1, None)] == pytest.approx(expected[1, 2, 1])
    assert table[("RMSE", "08", 1, 0, 400.0)] == pytest.approx(expected[0, 1, 0])
    assert len(table) == 2 * (12 + 12)
    saved = read_grid(spark, str(tmp_path / "scores"))
    assert saved.count() == len(table)

    figures = result.figures
    assert set(figures) == {
        "time_series", "cycle", "distribution", "member_subplots", "altitude_bin_subplots"
    }
    series = frames.as_dict(figures["time_series"], ["line", "time"])
    day = dt.date(2017, 10, 1)
    assert series[("ens_08_0-400", day)] == pytest.approx(daily(ens)[0, 0, 0].mean())
    assert series[("ens_mean_400-900", day)] == pytest.approx(daily(ens)[0, :, 1:].mean())
    assert series[("ref_na_0-400", day)] == pytest.approx(daily(ref)[0, 0].mean())
    assert figures["distribution"].count() == 6 * 5
    assert figures["member_subplots"].count() == 12
    assert {r.hour for r in figures["cycle"].collect()} == {0}
    panels = figures["altitude_bin_subplots"].collect()
    assert len(panels) == 6 and {r.bin_min for r in panels} == {0.0, 400.0}

    # Cells by band: altitudes 0, 50 | 400, 450, 800, 850.
    banded = {name: df.groupBy("bin_min").count().collect() for name, df in result.banded.items()}
    assert {n: {r.bin_min: r["count"] for r in rows} for n, rows in banded.items()} == {
        "ensemble": {0.0: 4, 400.0: 8}, "reference": {0.0: 2, 400.0: 4}, "maps": {0.0: 4, 400.0: 8}
    }
    assert any(df.is_cached for df in result.held)
    cached = list(result.held)
    result.release()
    assert result.held == [] and not any(df.is_cached for df in cached)


KEYS = ["metric", "member", "iy", "ix", "bin_min"]


def test_run_over_tables_by_month(spark, inputs, tmp_path):
    """The same scores as from tables read whole; months outside of the time slice are not looked at."""
    write_tables(inputs, tmp_path)
    c = config(tmp_path)
    c["plot"] = {"enabled": False}
    with pytest.warns(UserWarning, match="once more"):
        whole = frames.as_dict(v.run_config(spark, c).scores, KEYS, "score")
    for name in ("ens", "ref"):
        write_grid(spark.read.parquet(f"{tmp_path}/{name}"), f"{tmp_path}/{name}_by_month")
    inputs[4].write.parquet(f"{tmp_path}/cells")
    c["input"] |= {
        "by_month": True, "ensemble_pattern": f"{tmp_path}/ens_by_month", "reference_file": f"{tmp_path}/ref_by_month",
        "ensemble_cells": f"{tmp_path}/cells", "reference_cells": f"{tmp_path}/cells", "lat_name": "lat", "lon_name": "lon",
    }
    (tmp_path / "ens_by_month" / "year=2001" / "month=1" / "x=1").mkdir(parents=True)
    shutil.copy(next((tmp_path / "ens_by_month").rglob("*.parquet")), tmp_path / "ens_by_month" / "year=2001" / "month=1" / "x=1" / "a.parquet")
    assert frames.as_dict(v.run_config(spark, c).scores, KEYS, "score") == pytest.approx(whole)


def test_disabled_sections(spark, inputs, tmp_path):
    write_tables(inputs, tmp_path)
    c = config(tmp_path)
    for name in ("subset", "weather_types", "dem", "altitude_binning", "output"):
        c[name] = {}
    c["plot"] = {"enabled": False}
    c["ensemble"] = {"mean": True}
    inputs[4].write.parquet(f"{tmp_path}/cells")
    c["input"] |= {"ensemble_cells": f"{tmp_path}/cells", "lat_name": "lat", "lon_name": "lon"}
    result = v.run_config(spark, c)
    assert result.figures == {}
    assert set(result.scores.columns) == {"iy", "ix", "metric", "score"}
    assert result.scores.count() == 12


def test_reuse_follows_the_session(spark, inputs, monkeypatch):
    df = inputs[2]
    assert reuse.shared_folder(spark)
    kept = reuse.reuse(df)
    assert "Scan ExistingRDD" in plan(kept)
    assert kept.count() == df.count()
    monkeypatch.setattr(reuse, "shared_folder", lambda _: None)
    cached = reuse.reuse(df.where("iy >= 0"))
    assert cached.is_cached and cached.count() == df.count()
    cached.unpersist()
