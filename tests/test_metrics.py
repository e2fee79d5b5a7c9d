import math

import frames
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gridverify.operators import bands, metrics


@pytest.fixture(scope="module")
def sides(spark):
    model = frames.ensemble(
        spark,
        [
            ("2017-01-01", "00", 0, 0, 3.0),
            ("2017-01-01", "01", 0, 0, 1.0),
            ("2017-01-02", "00", 0, 0, 6.0),
            ("2017-01-02", "01", 0, 0, None),
            ("2017-01-02", "00", 0, 1, 5.0),
            ("2017-01-09", "00", 0, 0, 100.0),
        ],
    )
    reference = frames.reference(
        spark, [("2017-01-01", 0, 0, 1.0), ("2017-01-02", 0, 0, 2.0), ("2017-01-02", 0, 1, 8.0)]
    )
    return model, reference


def test_scalar(sides):
    row = metrics.all_metrics(*sides).first()
    # Errors 2, 0, 4, -3; the missing value and the unmatched day do not count.
    assert row.ME == pytest.approx(0.75)
    assert row.MAE == pytest.approx(2.25)
    assert row.RMSE == pytest.approx(math.sqrt(29 / 4))


def test_kept_dimensions(sides):
    maps = frames.as_dict(metrics.mean_error(*sides, dim="time"), ["member", "iy", "ix"], "ME")
    assert maps == {("00", 0, 0): 3.0, ("01", 0, 0): 0.0, ("00", 0, 1): -3.0}
    members = frames.as_dict(
        metrics.mean_absolute_error(*sides, dim=["time", "lat", "lon_coord"]), ["member"], "MAE"
    )
    assert members == {("00",): 3.0, ("01",): 0.0}


def test_unknown_dimension_or_metric(sides):
    with pytest.raises(ValueError, match="level"):
        metrics.mean_error(*sides, dim=["time", "level"])
    with pytest.raises(ValueError, match="CRPS"):
        metrics.score(metrics.pair(*sides), metrics=["CRPS"])


def test_season_in_place_of_time(sides):
    model, reference = (d.withColumnRenamed("time", "season") for d in sides)
    with pytest.raises(ValueError, match="season"):
        metrics.mean_error(model, reference, dim="time")


def test_reference_variable_name(sides):
    model, reference = sides
    renamed = reference.withColumnRenamed("value", "RR")
    found = metrics.mean_error(model, renamed, reference_value="RR").first()
    assert found.ME == pytest.approx(0.75)


def test_long_form(sides):
    long = metrics.to_long(metrics.all_metrics(*sides, dim=["time", "iy", "ix"]))
    assert set(long.columns) == {"member", "metric", "score"}
    assert long.count() == 6


def test_bands(spark, sides):
    errors = metrics.pair(*sides).withColumn("altitude", metrics.F.col("ix") * 500.0 + 100.0)
    banded = bands.altitude_bands(errors, [0, 500, 600])
    found = metrics.score(banded, ["time", "member", "iy", "ix"], by=["bin_min", "bin_max"])
    # Altitude 600 is above the last band.
    assert {(r.bin_min, r.bin_max): r.ME for r in found.collect()} == {(0.0, 500.0): 2.0}
    both = metrics.score_with_bands(bands.mark_bands(errors, [0, 500, 600]))
    assert {(r.bin_min, r.bin_max): r.ME for r in both.collect()} == {
        (None, None): 0.75, (0.0, 500.0): 2.0
    }


def test_band_edges(spark):
    df = frames.field(spark, [[-1, 0, 499.9, 500, 999, 1000, math.nan]]).withColumnRenamed(
        "value", "altitude"
    )
    found = frames.as_dict(bands.mark_bands(df, [0, 500, 1000]), ["ix"], "bin_min")
    assert found == {
        (0,): None, (1,): 0.0, (2,): 0.0, (3,): 500.0, (4,): 500.0, (5,): None, (6,): None
    }
    assert bands.altitude_bands(df, [0, 500, 1000]).count() == 4
    with pytest.raises(KeyError):
        bands.altitude_bands(df.drop("altitude"))
    with pytest.raises(ValueError):
        bands.mark_bands(df, [0, 0, 500])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=1, max_size=30))
def test_order_of_scores(spark, values):
    rows = [(i, 0, a, b) for i, (a, b) in enumerate(values)]
    both = spark.createDataFrame(rows, "iy INT, ix INT, a DOUBLE, b DOUBLE")
    row = metrics.all_metrics(
        both.selectExpr("iy", "ix", "a AS value"), both.selectExpr("iy", "ix", "b AS value")
    ).first()
    d = np.array([a - b for a, b in values])
    assert row.RMSE == pytest.approx(np.sqrt(np.mean(d**2)), abs=1e-9)
    assert abs(row.ME) <= row.MAE + 1e-9 and row.MAE <= row.RMSE + 1e-9
