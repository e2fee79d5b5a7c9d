"""A third of all rows on one cell: results against pandas and NumPy, without broadcasts."""

import frames
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_figures import scott_kde

from gridverify.operators import bands, distribution, grid, metrics, temporal

ROWS = 60_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture(scope="module")
def skewed(spark):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    key = lambda k: F.xxhash64("id", F.lit(k))
    cell = F.when(F.pmod(key(1), F.lit(3)) == 0, 0).otherwise(F.pmod(key(2), F.lit(40)))
    hours = F.make_dt_interval(hours=F.pmod(F.col("id"), F.lit(24 * 90)).cast("int"))
    df = spark.range(0, ROWS, 1, 12).select(
        (F.lit("2017-01-01 00:00:00").cast("timestamp_ntz") + hours).alias("time"),
        F.lpad(F.pmod(key(3), F.lit(4)).cast("string"), 2, "0").alias("member"),
        F.floor(cell / 8).cast("int").alias("iy"),
        F.pmod(cell, F.lit(8)).cast("int").alias("ix"),
        (F.pmod(key(4), F.lit(1000)) / 10.0).alias("value"),
    )
    yield df, df.toPandas()
    for k, v in before.items():
        spark.conf.set(k, v)


def test_scores(spark, skewed):
    df, table = skewed
    ens, ref = df.where("member <> '00'"), df.where("member = '00'").drop("member")
    dem = spark.range(40).select(
        F.floor(F.col("id") / 8).cast("int").alias("iy"),
        F.pmod(F.col("id"), F.lit(8)).cast("int").alias("ix"),
        (F.col("id") * 50.0).alias("altitude"),
    )
    observed = bands.mark_bands(
        grid.attach_altitude(temporal.aggregate_time(ref, "daily"), dem), (0, 500, 1000)
    )
    errors = metrics.pair(
        temporal.aggregate_time(ens, "daily"), observed, carry=("bin_min", "bin_max")
    )
    found = {
        (r.member, r.bin_min): (r.ME, r.RMSE)
        for r in metrics.score_with_bands(errors, ["time", "iy", "ix"]).collect()
    }
    table = table.assign(day=table.time.dt.floor("D"))
    sums = table.groupby(["day", "member", "iy", "ix"], as_index=False).value.sum()
    both = sums[sums.member != "00"].merge(
        sums[sums.member == "00"].drop(columns="member"), on=["day", "iy", "ix"]
    )
    both["d"] = both.value_x - both.value_y
    both["altitude"] = (both.iy * 8 + both.ix) * 50.0
    for member, part in both.groupby("member"):
        for low, rows in (
            (None, part),
            (0.0, part[part.altitude < 500]),
            (500.0, part[(part.altitude >= 500) & (part.altitude < 1000)]),
        ):
            expected = rows.d.mean(), np.sqrt((rows.d**2).mean())
            assert found[(member, low)] == pytest.approx(expected)
    assert len(found) == 9


def test_distributions(skewed):
    df, table = skewed
    counts = {}
    for r in distribution.histogram(df, ["iy", "ix"], bins=8).collect():
        counts.setdefault((r.iy, r.ix), {})[r.bin] = r["count"]
    curves = {}
    for r in distribution.density_curve(df, ["iy", "ix"], points=30).collect():
        curves.setdefault((r.iy, r.ix), {})[r.point] = r.density
    groups = {k: g.value.to_numpy() for k, g in table.groupby(["iy", "ix"])}
    assert set(counts) == set(curves) == set(groups)
    assert len(groups[(0, 0)]) > ROWS / 3
    for k, values in groups.items():
        assert [counts[k][i] for i in range(8)] == list(np.histogram(values, 8)[0])
        found = [curves[k][i] for i in range(30)]
        np.testing.assert_allclose(found, scott_kde(values, 30)[1], rtol=1e-9)


def test_band_counts_sum_to_the_cells_in_range(spark):
    dem = frames.field(spark, np.arange(60.0).reshape(6, 10) * 37 - 300).withColumnRenamed(
        "value", "altitude"
    )
    edges = (0, 250, 500, 1000)
    banded = bands.altitude_bands(dem, edges).groupBy("bin_min").count().collect()
    inside = dem.where("altitude >= 0 AND altitude < 1000").count()
    assert sum(r["count"] for r in banded) == inside and len(banded) == 3
