import fnmatch
import shutil

import frames
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridverify.functions.names import member_id
from gridverify.operators.select import slice_time
from gridverify.schema import REFERENCE
from gridverify.sources import readers, writers


def test_member_id(spark):
    names = ["rain_20170101_08.parquet", "rain_20170101_123.nc", "rain_01_part_22.x"]
    df = spark.createDataFrame([(n,) for n in names], "n STRING")
    good = df.where("n NOT LIKE '%123%'")
    assert sorted(r.m for r in good.select(member_id("n").alias("m")).collect()) == ["08", "22"]
    with pytest.raises(PySparkException, match="no member id"):
        df.select(member_id("n")).collect()


@pytest.fixture(scope="module")
def blocks(spark):
    return {
        m: frames.reference(
            spark, [(f"2017-{k:02}-01", 0, 0, k + offset) for k in (10, 11, 12)]
        )
        for m, offset in (("08", 0.25), ("09", 0.5))
    }


def test_ensemble_files_carry_their_member(spark, blocks, tmp_path):
    for m, df in blocks.items():
        df.coalesce(1).write.parquet(str(tmp_path / m))
        part = next((tmp_path / m).glob("part-*.parquet"))
        shutil.copy(part, tmp_path / f"rain_20171001_{m}.parquet")
    found = readers.read_ensemble(spark, str(tmp_path / "rain_*.parquet"), schema=REFERENCE)
    assert frames.as_dict(found.where("month(time) = 10"), ["member"]) == {
        ("08",): 10.25, ("09",): 10.5
    }
    assert found.count() == 6
    listed = readers.read_grid(spark, [str(tmp_path / f"rain_20171001_{m}.parquet") for m in blocks])
    assert listed.count() == 6
    with pytest.raises(FileNotFoundError):
        readers.read_ensemble(spark, str(tmp_path / "snow_*.parquet"))


def test_file_without_member_fails_every_query(spark, blocks, tmp_path):
    """Also one that doesn't read the member, or that keeps no row of that file."""
    from gridverify.operators.temporal import ensemble_mean

    for name, df in (("rain_20171001_08", blocks["08"]), ("rain_20171001", slice_time(blocks["09"], "2017-12"))):
        df.coalesce(1).write.parquet(str(tmp_path / "x" / name))
        shutil.copy(next((tmp_path / "x" / name).glob("part-*.parquet")), tmp_path / f"{name}.parquet")
    found = readers.read_ensemble(spark, str(tmp_path / "rain_*.parquet"), schema=REFERENCE)
    queries = [found, ensemble_mean(found), found.select("time"), found.where("value < 11"), slice_time(found, "2017-10", "2017-10"), found.groupBy("iy").count()]
    for query in queries:
        with pytest.raises((PySparkException, Py4JJavaError), match="no member id"):
            query.collect()
    with pytest.raises((PySparkException, Py4JJavaError), match="no member id"):
        found.count()
    named = readers.read_ensemble(spark, str(tmp_path / "rain_*_08.parquet"), schema=REFERENCE)
    assert ensemble_mean(named).count() == named.count() == 3


def test_member_folders(spark, blocks, tmp_path):
    path = str(tmp_path / "ens")
    both = readers.merge_by_coords([d.withColumn("member", F.lit(m)) for m, d in blocks.items()])
    both.write.option("partitionOverwriteMode", "static").partitionBy("member").parquet(path)
    found = readers.read_ensemble(spark, path)
    assert found.count() == 6 and "member" in found.columns


def test_merge(spark, blocks):
    first = blocks["08"]
    second = blocks["09"].withColumnRenamed("value", "other")
    merged = readers.merge_by_coords([first, second])
    assert merged.count() == 3 and merged.where("value IS NULL OR other IS NULL").count() == 0
    part = readers.merge_by_coords([first, slice_time(second, "2017-11")])
    assert part.count() == 3 and part.where("value IS NULL").count() == 0
    assert part.where("other IS NULL").count() == slice_time(second, end="2017-10").count() > 0
    gap = first.withColumn("value", F.lit(None).cast("double"))
    assert readers.merge_by_coords([first, gap]).where("value IS NULL").count() == 0
    assert readers.merge_by_coords([first, first], check_duplicates=False).count() == 3
    with pytest.raises(PySparkException, match="same coordinates"):
        readers.merge_by_coords([first, first], check_duplicates=True).collect()
    twice = readers.merge_by_coords([first, second, first])
    for query in (twice.select("time"), twice.select("other"), twice.groupBy("iy").count(), twice.agg(F.count("*"))):
        with pytest.raises(PySparkException, match="same coordinates"):
            query.collect()
    with pytest.raises(PySparkException, match="same coordinates"):
        twice.count()
    assert merged.columns == ["time", "iy", "ix", "value", "other"]
    later = slice_time(first, "2017-11")
    earlier = slice_time(first, end="2017-10")
    assert readers.merge_by_coords([later, earlier], check_duplicates=True).count() == 3


def test_written_months_are_skipped_when_sliced(spark, blocks, tmp_path):
    path = str(tmp_path / "ref")
    writers.write_grid(blocks["08"], path, files_per_month=2)
    found = slice_time(readers.read_grid(spark, path), "2017-11-01", "2017-11-30T23:00:00")
    assert [r.value for r in found.collect()] == [11.25]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "month" in plan.split("PartitionFilters: [")[1]
    writers.write_grid(blocks["08"].drop("time"), path, time=None)
    assert readers.read_grid(spark, path).count() == 3


@pytest.mark.parametrize(
    "start, end, months",
    [
        ("2016-11", "2017-02-10", {(2016, 11), (2016, 12), (2017, 1), (2017, 2)}),
        ("2017-01-31T12", None, {(2017, m) for m in range(1, 13)} | {(2018, m) for m in range(1, 13)}),
        (None, "2016-02", {(2015, m) for m in range(1, 13)} | {(2016, 1), (2016, 2)}),
        ("2017-03", "2017-03", {(2017, 3)}),
        ("2015-12", "2018-01", {(2015, 12), (2018, 1)} | {(y, m) for y in (2016, 2017) for m in range(1, 13)}),
        ("2030", None, set()),
        ("2017-05", "2017-04", set()),
    ],
)
def test_months_by_folder(spark, months_on_disk, start, end, months):
    """Only the folders of the months wanted are listed: one that spoils any listing of all of them does no harm."""
    path, whole = months_on_disk
    found = readers.read_months(spark, path, start, end)
    assert {(r.year, r.month) for r in found.collect()} <= months
    expected = slice_time(whole, start, end)
    assert sorted(map(str, found.select(*whole.columns).collect())) == sorted(map(str, expected.collect()))
    if months:
        relation = found._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation()
        assert relation.location().rootPaths().size() == len(months)


@pytest.fixture(scope="module")
def months_on_disk(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("months") / "grid"
    whole = spark.range(48).select(
        F.expr("timestamp_ntz'2015-01-20 06:00:00' + make_ym_interval(0, int(id))").alias("time"),
        F.lit(0).alias("iy"), F.col("id").cast("int").alias("ix"), F.col("id").cast("double").alias("value"),
    )
    writers.write_grid(whole.coalesce(1), str(path))
    return str(path), whole


def test_months_outside_are_not_looked_at(spark, blocks, tmp_path):
    path = tmp_path / "grid"
    writers.write_grid(blocks["08"], str(path))
    odd = path / "year=2016" / "month=1" / "part=x"
    odd.mkdir(parents=True)
    shutil.copy(next(path.rglob("*.parquet")), odd / "a.parquet")
    with pytest.raises(Exception, match="(?i)conflicting"):
        readers.read_grid(spark, str(path)).collect()
    assert readers.read_months(spark, str(path), "2017-10", "2017-11").count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_months(spark, str(tmp_path / "none"), "2017-10", "2017-11")


def test_years_without_bounds_keep_rows_without_a_time(spark, blocks, tmp_path):
    path = str(tmp_path / "grid")
    writers.write_grid(blocks["08"].union(blocks["08"].limit(1).withColumn("time", F.lit(None).cast("timestamp_ntz"))), path)
    assert readers.read_months(spark, path).count() == 4
    assert readers.read_months(spark, path, start="0001").count() == 3
    assert readers.read_months(spark, path, end="9998").count() == 3


@pytest.mark.parametrize("year", [1, 9, 10, 99, 2017, 1999, 2000, 9999])
def test_globs_of_other_years(year):
    """Against every year up to five digits, read as a shell pattern."""
    for later in (True, False):
        globs = readers._other_years(year, later)
        for y in (*range(1, 3000, 7), *range(year - 12, year + 13), 9998, 10_000, 99_999):
            if y > 0:
                assert any(fnmatch.fnmatchcase(str(y), g) for g in globs) == (y > year if later else y < year)


def test_dem(spark, tmp_path):
    cells = frames.cells(spark, [46, 47, 48], [10, 11])
    cells.withColumn("ZH", F.col("iy") * 100.0).write.parquet(str(tmp_path / "dem"))
    whole = readers.read_dem(spark, str(tmp_path / "dem"))
    assert set(whole.columns) == {"iy", "ix", "altitude", "lat_coord", "lon_coord"}
    assert whole.count() == 6
    cropped = readers.read_dem(
        spark, str(tmp_path / "dem"), lat_bounds=(46.5, 48), lon_bounds=(10, 10.5)
    )
    assert frames.as_dict(cropped, ["iy", "ix"], "altitude") == {(1, 0): 100.0, (2, 0): 200.0}
    one_bound = readers.read_dem(spark, str(tmp_path / "dem"), lat_bounds=(46.5, 48))
    assert one_bound.count() == 6
    with pytest.raises(ValueError, match="height"):
        readers.read_dem(spark, str(tmp_path / "dem"), "height")


def test_weather_csv(spark, tmp_path):
    path = tmp_path / "types.csv"
    path.write_text("date,slwt,note\n2017-10-02 11:00:00,3.0,x\n2017-10-01 11:00:00,6,y\n2017-10-03,1,z\n")
    found = readers.read_weather_types(spark, str(path))
    assert found.dtypes == [("time", "timestamp_ntz"), ("slwt", "int")]
    assert sorted(r.slwt for r in found.collect()) == [1, 3, 6]
    assert found.where("time IS NULL").count() == 0
    with pytest.raises(KeyError):
        readers.read_weather_types(spark, str(path), weather_type="gwt")


def test_scores_round_trip(spark, tmp_path):
    scores = spark.createDataFrame(
        [("08", 1.0, 2.0, 3.0)], "member STRING, ME DOUBLE, MAE DOUBLE, RMSE DOUBLE"
    )
    path = str(tmp_path / "scores")
    writers.write_scores(scores, path)
    writers.write_scores(scores, path)
    found = readers.read_grid(spark, path)
    assert {(r.metric, r.score) for r in found.collect()} == {("ME", 1.0), ("MAE", 2.0), ("RMSE", 3.0)}


def test_months_are_gathered_into_few_files(spark, tmp_path):
    path = tmp_path / "grid"
    hours = spark.range(20_000, numPartitions=8).select(
        F.expr("timestamp_ntz'2016-01-01 00:00:00' + make_dt_interval(0, id)").alias("time"),
        F.lit(0).alias("iy"), F.lit(0).alias("ix"), F.col("id").cast("double").alias("value"),
    )
    writers.write_grid(hours.repartition(8), str(path))
    months = hours.select(F.trunc("time", "month")).distinct().count()
    assert len(list(path.rglob("*.parquet"))) <= 2 * months
    writers.write_grid(hours.repartition(8), str(path), gather=False)
    assert len(list(path.rglob("*.parquet"))) > 4 * months
    assert readers.read_grid(spark, str(path)).count() == 20_000
