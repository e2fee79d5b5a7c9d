import math

import frames
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridverify.operators import grid


def axis(spark, values):
    return spark.createDataFrame(
        [(i, float(c)) for i, c in enumerate(values)], "i INT, c DOUBLE"
    )


def nearest_by_hand(source, target):
    """Nearest index, a tie going to the lower coordinate; None beyond the ends."""
    out = {}
    for k, t in enumerate(target):
        inside = min(source) <= t <= max(source)
        out[k] = min(range(len(source)), key=lambda i: (abs(source[i] - t), source[i])) if inside else None
    return out


def nearest_found(spark, source, target, cuts=None):
    found = grid.nearest_axis(axis(spark, source), axis(spark, target), cuts).collect()
    assert len(found) == len(target)
    return {r.target_i: r.source_i if r.inside else None for r in found}


def test_nearest_ties_and_ends(spark):
    source = [46.0, 46.25, 46.5]
    target = [45.99, 46.0, 46.125, 46.2, 46.25, 46.375, 46.4, 46.5, 46.51]
    assert nearest_found(spark, source, target) == {
        0: None, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: None
    }


def test_nearest_on_an_unsorted_axis(spark):
    source, target = [50.0, 46.0, 48.0], [46.9, 47.0, 47.1, 49.5]
    assert nearest_found(spark, source, target) == {0: 1, 1: 1, 2: 2, 3: 0}


def test_nearest_between_far_clusters(spark, monkeypatch):
    source = [0.0, 1e-6, 2e-6, 1e6, 1e6 + 0.5]
    target = [1.0, 499_999.0, 500_001.0, 999_999.0, 1e6 + 0.2, 0.4e-6]
    for cuts in (None, [0.0, 1e-6, 0.4, 2e5, 5e5, 1e6, 1e6 + 0.5]):
        assert nearest_found(spark, source, target, cuts) == nearest_by_hand(source, target)


def test_long_target_axis_over_two_points_is_split(spark, monkeypatch):
    monkeypatch.setattr(grid, "RANGE_ROWS", 10)
    source = frames.cells(spark, [40.0, 60.0], [10.0, 11.0])
    target = frames.cells(spark, [float(v) for v in range(100)], [10.0, 11.0])
    sizes = grid.measure({"s": source, "t": target})
    assert (sizes["t"].cells, dict(sizes["t"].lengths)) == (200, {"iy": 100, "ix": 2})
    assert len(sizes["t"].cuts["iy"]) > 50 and sizes["s"].cuts["iy"] == [40.0, 60.0]
    found, _ = grid.axis_maps(source, target, sizes=(sizes["s"], sizes["t"]))
    assert {r.target_i: r.source_i for r in found.collect() if r.inside} == {
        v: int(v > 50) for v in range(40, 61)
    }
    assert found.count() == 100


def test_single_source_coordinate(spark):
    assert nearest_found(spark, [46.0], [45.0, 46.0, 47.0]) == {0: None, 1: 0, 2: None}


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.integers(-400, 400), min_size=1, max_size=60, unique=True),
    st.lists(st.integers(-1700, 1700), min_size=1, max_size=60, unique=True),
)
def test_nearest_equals_comparing_all_pairs(spark, source, target):
    source, target = [s / 2 for s in source], [t / 8 for t in target]
    expected = nearest_by_hand(source, target)
    assert nearest_found(spark, source, target) == expected
    # As on a long axis: searched in several ranges, cut on either side's coordinates.
    cuts = sorted({*source[::5], *target[::7]})
    assert nearest_found(spark, source, target, cuts) == expected


def test_linear_in_ranges(spark):
    source, target = [float(v * v) for v in range(12)], [v / 2 for v in range(-2, 246)]
    rows = lambda: sorted(map(tuple, grid.linear_axis(axis(spark, source), axis(spark, target)).collect()))
    whole = rows()
    cuts = [source[0], 5.0, 30.5, 64.0, 100.0, target[-1]]
    ranged = grid.linear_axis(axis(spark, source), axis(spark, target), cuts)
    assert sorted(map(tuple, ranged.collect())) == whole


def test_regrid_on_its_own_grid_changes_nothing(spark):
    cells = frames.cells(spark, [46, 46.5, 47.25], [10, 11])
    data = frames.field(spark, [[1, 2], [3, math.nan], [5, 6]])
    for method in ("nearest", "linear"):
        same = grid.regrid(data, cells, cells, method=method)
        if method == "nearest":
            np.testing.assert_array_equal(frames.array(same), frames.array(data))
    with pytest.raises(ValueError, match="cubic"):
        grid.regrid(data, cells, cells, method="cubic")


def test_regrid_outside_value(spark):
    source, target = frames.cells(spark, [46, 47], [10, 11]), frames.cells(spark, [46, 48], [10.4, 11])
    data = frames.field(spark, [[1, 2], [3, 4]])
    maps = grid.axis_maps(source, target)
    np.testing.assert_array_equal(
        frames.array(grid.regrid_nearest(data, *maps)), [[1, 2], [np.nan, np.nan]]
    )
    np.testing.assert_array_equal(
        frames.array(grid.regrid_nearest(data, *maps, outside=0.0)), [[1, 2], [0, 0]]
    )


def successive_linear(values, lats, lons, new_lats, new_lons):
    """Interpolate along latitude, then longitude; NaN spreads from either neighbour."""

    def along(x, y, new):  # y: (len(x), m)
        hi = np.clip(np.searchsorted(x, new, side="left"), 1, len(x) - 1)
        lo = hi - 1
        slope = (y[hi] - y[lo]) / (x[hi] - x[lo])[:, None]
        out = slope * (new - x[lo])[:, None] + y[lo]
        out[(new < x[0]) | (new > x[-1])] = np.nan
        return out

    half = along(lats, values, new_lats)
    return along(lons, half.T, new_lons).T


def test_linear(spark):
    lats, lons = np.array([46.0, 46.5, 47.5]), np.array([10.0, 10.25, 11.0])
    values = np.array([[1.0, 2.0, 4.0], [3.0, 7.0, 5.0], [8.0, 6.0, 9.0]])
    new_lats = np.array([45.9, 46.0, 46.2, 46.5, 47.0, 47.5, 47.6])
    new_lons = np.array([10.0, 10.1, 10.25, 10.9, 11.0])
    found = grid.regrid(
        frames.field(spark, values),
        frames.cells(spark, lats, lons),
        frames.cells(spark, new_lats, new_lons),
        method="linear",
    )
    expected = successive_linear(values, lats, lons, new_lats, new_lons)
    np.testing.assert_allclose(frames.array(found), expected, rtol=1e-12)


def test_linear_missing_corner(spark):
    lats = lons = np.array([0.0, 1.0, 2.0])
    values = np.array([[1.0, 2.0, 3.0], [4.0, np.nan, 6.0], [7.0, 8.0, 9.0]])
    new = np.array([0.5, 1.5, 2.0])
    cells, target = frames.cells(spark, lats, lons), frames.cells(spark, new, new)
    found = grid.regrid(frames.field(spark, values), cells, target, method="linear")
    expected = successive_linear(values, lats, lons, new, new)
    np.testing.assert_array_equal(np.isnan(frames.array(found)), np.isnan(expected))


def test_axes(spark):
    # Curvilinear: the axes are the first column and the first row.
    cells = spark.createDataFrame(
        [(0, 0, 46.0, 10.0), (0, 1, 46.1, 11.0), (1, 0, 47.0, 10.2), (1, 1, 47.1, 11.2)],
        "iy INT, ix INT, lat DOUBLE, lon DOUBLE",
    )
    found = grid.rectilinear(cells)
    assert frames.as_dict(found, ["iy", "ix"], "lat_coord")[(1, 1)] == 47.0
    assert frames.as_dict(found, ["iy", "ix"], "lon_coord")[(1, 1)] == 11.0


def test_altitude(spark):
    data = frames.field(spark, [[1, 2]]).withColumn("lambert_conformal_conic", F.lit(1))
    dem = spark.createDataFrame([(0, 0, 700.0), (9, 9, 1.0)], "iy INT, ix INT, altitude DOUBLE")
    found = grid.attach_altitude(data, dem)
    assert found.columns == ["iy", "ix", "value", "altitude"]
    assert frames.as_dict(found, ["iy", "ix"], "altitude") == {(0, 0): 700.0, (0, 1): None}


def test_regrid_commutes_with_aggregation(spark):
    from gridverify.operators.temporal import aggregate_time

    rows = [
        (f"2017-01-0{d}T{h:02}:00:00", m, y, x, float(d * h + y * 7 + x * 3))
        for d in (1, 2) for h in (0, 6) for m in ("00", "01") for y in range(3) for x in range(2)
    ]
    data = frames.ensemble(spark, rows)
    source = frames.cells(spark, [46, 47, 48], [10, 11])
    target = frames.cells(spark, [46.2, 46.5, 47.9], [10.5, 10.6])
    maps = grid.axis_maps(source, target)
    first = aggregate_time(grid.regrid_nearest(data, *maps), "daily")
    last = grid.regrid_nearest(aggregate_time(data, "daily"), *maps)
    keys = ["time", "member", "iy", "ix"]
    assert frames.as_dict(first, keys) == frames.as_dict(last, keys)
