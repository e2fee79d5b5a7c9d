import datetime as dt

import frames
import pytest

from gridverify.operators import temporal
from gridverify.operators.masks import wet_filter


@pytest.fixture(scope="module")
def hours(spark):
    return frames.ensemble(
        spark,
        [
            ("2016-12-31T23:00:00", "00", 0, 0, 1.0),
            ("2017-01-01T00:00:00", "00", 0, 0, 2.0),
            ("2017-01-01T12:00:00", "00", 0, 0, 4.0),
            ("2017-01-01T12:00:00", "01", 0, 0, 8.0),
            ("2017-02-28T12:00:00", "00", 0, 0, -999.0),
            ("2017-03-01T12:00:00", "00", 0, 0, float("nan")),
            ("2017-03-01T13:00:00", "00", 0, 0, 5.0),
        ],
    )


def by(df, label="time"):
    return frames.as_dict(df, [label, "member"])


def test_daily(hours):
    found = by(temporal.aggregate_time(hours, "daily", missing_value=-999))
    assert found == {
        (dt.date(2016, 12, 31), "00"): 1.0,
        (dt.date(2017, 1, 1), "00"): 6.0,
        (dt.date(2017, 1, 1), "01"): 8.0,
        (dt.date(2017, 2, 28), "00"): 0.0,
        (dt.date(2017, 3, 1), "00"): 5.0,
    }


def test_sum_of_nothing(hours):
    feb = (dt.date(2017, 2, 28), "00")
    agg = lambda **k: by(temporal.aggregate_time(hours, "daily", missing_value=-999, **k))
    assert agg()[feb] == 0.0
    assert agg(min_count=1)[feb] is None
    assert agg(method="mean")[feb] is None


def test_labels(hours):
    monthly = by(temporal.aggregate_time(hours, "monthly", missing_value=-999))
    assert monthly[(dt.date(2017, 1, 31), "00")] == 6.0
    assert (dt.date(2017, 2, 28), "00") in monthly
    yearly = by(temporal.aggregate_time(hours, "yearly", missing_value=-999))
    assert yearly[(dt.date(2017, 12, 31), "00")] == 11.0
    seasonal = by(temporal.aggregate_time(hours, "seasonal", missing_value=-999), "season")
    # December 2016 and January 2017 share a season.
    assert seasonal[("DJF", "00")] == 7.0
    assert seasonal[("MAM", "00")] == 5.0


def test_ensemble_mean_comes_first(hours):
    found = temporal.aggregate_time(hours, "daily", missing_value=-999, compute_ens_mean=True)
    assert frames.as_dict(found, ["time"])[(dt.date(2017, 1, 1),)] == 2.0 + 6.0


def test_daily_then_monthly_is_monthly(hours):
    daily = temporal.aggregate_time(hours, "daily", missing_value=-999)
    assert by(temporal.aggregate_time(daily, "monthly")) == by(
        temporal.aggregate_time(hours, "monthly", missing_value=-999)
    )


def test_pass_through(hours):
    for period in ("none", "hourly"):
        found = temporal.aggregate_time(hours, period, missing_value=-999)
        assert found.count() == hours.count()
        assert sorted(r.value for r in found.dropna().collect()) == [1, 2, 4, 5, 8]
    with pytest.warns(UserWarning, match="weekly"):
        assert temporal.aggregate_time(hours, "weekly").count() == hours.count()


def test_arguments_are_checked(hours):
    with pytest.raises(ValueError, match="median"):
        temporal.aggregate_time(hours, "daily", method="median")
    with pytest.raises(ValueError, match="rain"):
        temporal.aggregate_time(hours, "daily", value="rain")


def test_masked_cells_sum_to_zero(hours):
    dry = wet_filter(hours, 100.0)
    assert set(by(temporal.aggregate_time(dry, "yearly")).values()) == {0.0}
    assert set(by(temporal.aggregate_time(dry, "yearly", min_count=1)).values()) == {None}


def test_weather_type_mean(spark):
    df = frames.reference(
        spark,
        [("2017-10-01T00:00:00", 0, 0, 1.0), ("2017-10-01T06:00:00", 0, 0, 2.0),
         ("2017-10-02T00:00:00", 0, 0, 9.0), ("2017-10-03T00:00:00", 0, 0, None)],
    )
    weather = frames.weather(
        spark,
        [("2017-10-01T11:00:00", 6), ("2017-10-02T11:00:00", 6), ("2017-10-02T23:00:00", 6),
         ("2017-10-02T12:00:00", 2), ("2017-10-03T11:00:00", 5)],
    )
    found = frames.as_dict(temporal.weather_type_mean(df, weather), ["slwt"])
    # Type 6: the mean of all three values, not of the daily means.
    assert found == {(6,): 4.0, (2,): 9.0, (5,): None}
