import math

import frames
import pytest
from pyspark.sql import functions as F

from gridverify.operators import masks


def values(df, name="value"):
    return [r[name] for r in df.orderBy("iy", "ix").collect()]


def test_nan_and_sentinel_become_null(spark):
    df = spark.createDataFrame(
        [(0, 0, 1.0), (0, 1, -999.0), (0, 2, math.nan), (0, 3, None)], "iy INT, ix INT, value DOUBLE"
    )
    assert values(masks.clean_values(df, missing_value=-999)) == [1.0, None, None, None]
    assert values(masks.clean_values(df)) == [1.0, -999.0, None, None]


def test_wet_filter_masks_every_variable(spark):
    df = frames.field(spark, [[0.05, 0.1, 3.0, math.nan]]).withColumn("other", F.col("ix") + 10.0)
    wet = masks.wet_filter(df, 0.1)
    assert values(wet) == [None, 0.1, 3.0, None]
    assert values(wet, "other") == [None, 11.0, 12.0, None]
    assert values(masks.wet_filter(df, 0.1, variables=["value"]), "other") == [10.0, 11.0, 12.0, 13.0]
    assert values(masks.wet_filter(df, 0.1, mask_as_zero=True)) == [0.0, 0.1, 3.0, None]
    assert values(masks.wet_filter(df, 0.1, mask_as_zero=True), "other") == [0.0, 11.0, 12.0, None]
    with pytest.warns(UserWarning):
        assert masks.wet_filter(df, 0.1, "rain") is df


def test_range_is_half_open(spark):
    df = frames.field(spark, [[3.9, 4.0, 7.9, 8.0, math.nan]])
    assert values(masks.value_range(df, 4, 8)) == [None, 4.0, 7.9, None, None]


def test_units(spark):
    df = frames.field(spark, [[273.15, 283.15]])
    kelvin = df.withMetadata("value", {"units": "K"})
    converted = masks.unify_temperature_units(kelvin)
    assert values(converted) == [0.0, 10.0]
    assert converted.schema["value"].metadata["units"] == "degree_Celsius"
    # Converting again changes nothing.
    assert values(masks.unify_temperature_units(converted)) == [0.0, 10.0]
    assert values(masks.unify_temperature_units(df, units="degC")) == [273.15, 283.15]
    # "kelvin/cycle" holds both letters: the "c" wins.
    assert values(masks.unify_temperature_units(df, units="kelvin/cycle")) == [273.15, 283.15]
    with pytest.warns(UserWarning, match="Kelvin"):
        assert values(masks.unify_temperature_units(df)) == [0.0, 10.0]
    with pytest.warns(UserWarning, match="unknown"):
        assert values(masks.unify_temperature_units(df, units="mm")) == [273.15, 283.15]
    with pytest.warns(UserWarning, match="not supported"):
        assert masks.unify_temperature_units(kelvin, target="F") is kelvin
    assert masks.unify_temperature_units(df, "t2m") is df


@pytest.mark.parametrize(
    "name, expected", [("Temperature_2m", True), ("T2M", True), ("precipitation", False)]
)
def test_temperature_names(name, expected):
    assert masks.is_temperature(name) is expected


def test_drop_projection(spark):
    df = frames.field(spark, [[1.0]]).withColumn("lambert_conformal_conic", F.lit(0))
    assert masks.drop_projection(df).columns == ["iy", "ix", "value"]
    assert masks.drop_missing(frames.field(spark, [[1.0, math.nan]])).count() == 1


def test_nan_counts_as_missing_everywhere(spark):
    from gridverify.operators import maps, metrics, quality, series, temporal

    df = frames.field(spark, [[1.0, 2.0, 900.0]])
    raw = df.withColumn("value", F.when(F.col("ix") == 1, F.lit(math.nan)).otherwise(F.col("value")))
    assert quality.missing_count(raw).first().missing == 1
    assert quality.outlier_count(raw).first().outliers == 1
    row = quality.profile(raw).first()
    assert (row.n_rows, row.n_value, row.max_value) == (3, 2, 900.0)
    assert series.area_mean(raw).first().value == 450.5
    assert metrics.mean_error(raw, df).first().ME == 0.0
    members = raw.withColumn("member", F.lit("00"))
    assert values(temporal.ensemble_mean(members)) == [1.0, None, 900.0]
    assert values(maps.time_map(raw)) == [1.0, 0.0, 900.0]
