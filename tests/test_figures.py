import datetime as dt
import math

import frames
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridverify.operators import distribution, lines, maps, series

CONFIG = {
    "alt_bin_ranges": [[0, 500], [500, 1000]],
    "ensemble_members": ["08", "09"],
    "include_reference": True,
}


def test_build_lines():
    built = lines.build_lines(CONFIG)
    assert [line.label for line in built] == [
        "ens_08_0-500", "ens_09_0-500", "ens_08_500-1000", "ens_09_500-1000",
        "ref_na_0-500", "ref_na_500-1000",
    ]
    assert [line.label for line in lines.build_cycle_lines({**CONFIG, "include_reference": False})][
        0
    ] == "ens-08_0-500"
    custom = {**CONFIG, "ensemble_members": "mean", "label_template": "{source} {member} alt={alt_min}-{alt_max}"}
    assert lines.build_lines(custom)[0].label == "ens mean alt=0-500"
    with pytest.raises(ValueError):
        lines.build_lines({**CONFIG, "ensemble_members": 8})


@pytest.fixture(scope="module")
def sides(spark):
    alt = F.when(F.col("ix") == 0, 100.0).when(F.col("ix") == 1, 700.0)
    ens = frames.ensemble(
        spark,
        [
            (f"2017-0{1 + d}-0{1 + d}", m, 0, x, float(10 * d + x + (5 if m == "09" else 0)))
            for d in range(3) for m in ("08", "09") for x in range(3)
        ],
    )
    ref = frames.reference(
        spark, [(f"2017-0{1 + d}-0{1 + d}", 0, x, float(d + x)) for d in range(3) for x in range(3)]
    )
    return ens.withColumn("altitude", alt), ref.withColumn("altitude", alt)


def test_series_of_lines(sides):
    found = frames.as_dict(series.line_series(*sides, lines.build_lines(CONFIG)), ["line", "time"])
    first = dt.datetime(2017, 1, 1)
    assert found[("ens_08_0-500", first)] == 0.0
    assert found[("ens_09_500-1000", first)] == 6.0
    assert found[("ref_na_500-1000", first)] == 1.0
    # The cell without an altitude feeds no line.
    assert len(found) == 6 * 3


def test_member_choices(sides):
    choose = lambda members: frames.as_dict(
        series.line_series(*sides, [lines.Line("x", "ensemble", members)]), ["member", "time"]
    )
    first = dt.datetime(2017, 1, 1)
    assert choose("all") == choose(None) == choose(("08", "09"))
    assert choose("all")[("09", first)] == 6.0
    assert choose("mean") == {
        (None, dt.datetime(2017, 1 + d, 1 + d)): 10 * d + 1 + 2.5 for d in range(3)
    }
    assert set(k[0] for k in choose("09")) == {"09"}


def test_lines_may_overlap(sides):
    both = [lines.Line("low", altitude=(0, 800)), lines.Line("all", altitude=(0, 9000))]
    rows = lines.line_values(*sides, both)
    assert rows.groupBy("line").count().count() == 2
    with pytest.raises(ValueError, match="satellite"):
        lines.line_values(*sides, [lines.Line("x", "satellite")])


def test_lines_without_altitude(sides):
    ens, ref = (s.drop("altitude") for s in sides)
    with pytest.warns(UserWarning, match="altitude"):
        rows = lines.line_values(ens, ref, [lines.Line("x", altitude=(0, 1))])
    assert rows.count() == ens.count()
    with pytest.warns(UserWarning, match="rain"), pytest.raises(ValueError):
        lines.line_values(ens, ref, [lines.Line("x")], ensemble_value="rain")


def test_trend(spark):
    df = spark.createDataFrame(
        [("a", dt.datetime(2017, 1, d, 13), float(3 * d + 1)) for d in (1, 2, 5)]
        + [("a", dt.datetime(2017, 1, 6), None), ("b", dt.datetime(2017, 1, 1), 4.0)],
        "line STRING, time TIMESTAMP_NTZ, value DOUBLE",
    )
    found = frames.as_dict(series.add_trend(df), ["line", "time"], "trend")
    assert found[("a", dt.datetime(2017, 1, 5, 13))] == pytest.approx(16.0)
    # Fitted also where the value is missing; a single value has no trend.
    assert found[("a", dt.datetime(2017, 1, 6))] == pytest.approx(19.0)
    assert found[("b", dt.datetime(2017, 1, 1))] is None
    alone = series.add_trend(df.where("line = 'a'").drop("line"))
    assert frames.as_dict(alone, ["time"], "trend")[(dt.datetime(2017, 1, 5, 13),)] == pytest.approx(16.0)


def test_cycle_is_a_mean_of_area_means(spark):
    df = frames.reference(
        spark,
        [("2017-01-01T05:00:00", 0, 0, 0.0), ("2017-01-01T05:00:00", 0, 1, 0.0),
         ("2017-01-02T05:00:00", 0, 0, 6.0)],
    )
    found = series.mean_cycle(series.area_mean(df), "diurnal")
    assert frames.as_dict(found, ["hour"]) == {(5,): 3.0}
    with pytest.warns(UserWarning, match="weekly"):
        assert series.mean_cycle(series.area_mean(df), "weekly").count() == 0


@pytest.mark.parametrize("bins", [1, 7, 20])
@pytest.mark.parametrize("few", [0, 100_000])
def test_histogram_equals_numpy(spark, monkeypatch, bins, few):
    monkeypatch.setattr(distribution, "BROADCAST_GROUPS", few)
    monkeypatch.setattr(distribution, "HEAVY_SHARE", 2)
    rng = np.random.default_rng(3)
    groups = {
        "a": np.round(rng.gamma(2.0, 5.0, 500), 1),
        "b": np.arange(0, 2.1, 0.1),
        "c": np.array([4.0, 4.0]),
    }
    rows = [(k, 0, i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    rows += [("d", 0, 0, None)]
    df = spark.createDataFrame(rows, "g STRING, iy INT, ix INT, value DOUBLE")
    found = distribution.histogram(df, ["g"], bins=bins)
    table = {}
    for r in found.collect():
        table.setdefault(r.g, {})[r.bin] = (r["count"], r.bin_left, r.bin_right)
    assert set(table) == set(groups)
    for k, vs in groups.items():
        counts, edges = np.histogram(vs, bins)
        assert [table[k][i][0] for i in range(bins)] == list(counts)
        np.testing.assert_allclose([table[k][i][1] for i in range(bins)], edges[:-1])
        np.testing.assert_allclose([table[k][i][2] for i in range(bins)], edges[1:])


def scott_kde(values, points=200):
    h = np.std(values, ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min(), values.max(), points)
    z = (x[:, None] - values[None, :]) / h
    return x, np.exp(-0.5 * z * z).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("few", [0, 100_000])
def test_density_equals_the_sum_of_kernels(spark, monkeypatch, few):
    monkeypatch.setattr(distribution, "BROADCAST_GROUPS", few)
    rng = np.random.default_rng(5)
    groups = {
        "gamma": rng.gamma(0.5, 3.0, 4000),
        "rain": np.concatenate([np.zeros(2000), rng.gamma(1.0, 9.0, 300)]),
        "far": np.concatenate([rng.normal(0, 1e-3, 500), [1e4]]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(k, 0, i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    rows += [("one", 0, 0, 1.0), ("flat", 0, 0, 2.0), ("flat", 0, 1, 2.0), ("none", 0, 0, None)]
    df = spark.createDataFrame(rows, "g STRING, iy INT, ix INT, value DOUBLE")
    table = {}
    for r in distribution.density_curve(df, ["g"]).collect():
        table.setdefault(r.g, {})[r.point] = (r.x, r.density)
    assert set(table) == set(groups)
    for k, vs in groups.items():
        x, expected = scott_kde(vs)
        assert sorted(table[k]) == list(range(200))
        np.testing.assert_allclose([table[k][i][0] for i in range(200)], x, rtol=1e-12, atol=1e-12)
        density = np.array([table[k][i][1] for i in range(200)])
        np.testing.assert_allclose(density, expected, rtol=1e-9, atol=1e-13 * expected.max())


def test_distributions_without_groups(spark):
    values = np.arange(50.0) ** 1.5
    df = frames.field(spark, values[None, :])
    counts = {r.bin: r["count"] for r in distribution.histogram(df, bins=9).collect()}
    assert [counts[i] for i in range(9)] == list(np.histogram(values, 9)[0])
    found = frames.as_dict(distribution.density_curve(df, points=40), ["point"], "density")
    expected = scott_kde(values, 40)[1]
    np.testing.assert_allclose([found[(i,)] for i in range(40)], expected, rtol=1e-9)
    empty = df.where("ix < 0")
    assert distribution.histogram(empty).count() == distribution.density_curve(empty).count() == 0


def test_line_distributions(sides):
    built = lines.build_lines(CONFIG)
    hist = distribution.line_distribution(*sides, built, "hist", bins=4)
    assert hist.groupBy("line").agg(F.sum("count").alias("n")).where("n = 3").count() == 6
    reduced = distribution.line_distribution(*sides, built, "hist", bins=4, reduce_dims=["time"])
    assert reduced.groupBy("line").agg(F.sum("count").alias("n")).where("n = 1").count() == 6
    assert distribution.line_distribution(*sides, built, "kde", points=5).count() == 30
    with pytest.warns(UserWarning, match="box"):
        assert distribution.line_distribution(*sides, built, "box") is None


def test_single_map_needs_a_single_member(spark):
    scores = spark.createDataFrame(
        [("00", 0, 0, 1.0), ("01", 0, 0, 2.0)], "member STRING, iy INT, ix INT, RMSE DOUBLE"
    )
    with pytest.raises(PySparkException, match="member_panels"):
        maps.single_map(scores, "RMSE").collect()
    one = maps.single_map(scores.where("member = '01'"), "RMSE").collect()
    assert [(r.iy, r.ix, r.score) for r in one] == [(0, 0, 2.0)]
    assert maps.member_panels(scores, "RMSE").count() == 2
    with pytest.raises(ValueError):
        maps.member_panels(scores.drop("member"), "RMSE")


def test_kernels_that_do_not_reach_add_nothing(spark, monkeypatch):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(0, 1, 300), rng.normal(1e4, 1, 300), [5e3]])
    df = frames.field(spark, values[None, :])
    curve = lambda: frames.as_dict(distribution.density_curve(df, points=300), ["point"], "density")
    near = curve()
    monkeypatch.setattr(distribution, "KERNEL_REACH", 1e9)
    assert near == curve() and len(near) == 300


def test_dimensions_reduced_line_by_line(sides):
    low, high = (0, 500), (500, 1000)
    chosen = [
        lines.Line("cells", "ensemble", "08", low),
        lines.Line("times", "ensemble", "08", low, ("time",)),
        lines.Line("members", "ensemble", "all", high, ("member", "lat", "lon")),
    ]
    found = series.line_series(*sides, chosen)
    table = {(r.line, r.time, r.member, r.ix): r.value for r in found.collect()}
    day = lambda d: dt.datetime(2017, 1 + d, 1 + d)
    assert table == {
        **{("cells", day(d), "08", None): 10.0 * d for d in range(3)},
        ("times", None, "08", 0): 10.0,
        **{("members", day(d), None, None): 10 * d + 1 + 2.5 for d in range(3)},
    }
    hist = distribution.line_distribution(*sides, chosen, "hist", bins=2)
    assert {r.line: r.n for r in hist.groupBy("line").agg(F.sum("count").alias("n")).collect()} == {"cells": 3, "times": 1, "members": 3}
    built = lines.build_lines({**CONFIG, "reduce_dims": ["lat", "lon"]})
    assert {line.reduce_dims for line in built} == {("iy", "ix")}
