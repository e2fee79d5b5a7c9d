import os
import subprocess
import sys
from datetime import date, datetime, timezone
from pathlib import Path

import compare
import frames
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from gridverify.operators import masks, select
from gridverify.operators.temporal import aggregate_time
from gridverify.plans import roles, verification

SF_DIR = "/root/testdata/sf0.001"
# A subquery's error reaches Python without a class of its own.
FAILS = (PySparkException, Py4JJavaError)


@pytest.mark.parametrize(
    "text, first, after",
    [
        ("2016", datetime(2016, 1, 1), datetime(2017, 1, 1)),
        ("2016-02", datetime(2016, 2, 1), datetime(2016, 3, 1)),
        ("2016-02-29", datetime(2016, 2, 29), datetime(2016, 3, 1)),
        ("2016-06-01T05", datetime(2016, 6, 1, 5), datetime(2016, 6, 1, 6)),
        ("2016-06-01 05:30", datetime(2016, 6, 1, 5, 30), datetime(2016, 6, 1, 5, 31)),
        ("2016-06-01T05:30:10", datetime(2016, 6, 1, 5, 30, 10), datetime(2016, 6, 1, 5, 30, 11)),
        (date(2016, 6, 1), datetime(2016, 6, 1), datetime(2016, 6, 2)),
    ],
)
def test_time_label_covers_its_resolution(text, first, after):
    assert select.time_span(text) == (first, after)


def test_unreadable_time():
    with pytest.raises(ValueError):
        select.time_span("June 2016")


def test_time_slice_is_closed(spark):
    df = frames.reference(
        spark,
        [
            ("2017-09-30T23:59:59", 0, 0, 1.0),
            ("2017-10-01T00:00:00", 0, 0, 2.0),
            ("2017-10-02T23:00:00", 0, 0, 3.0),
            ("2017-10-02T23:00:00.500", 0, 0, 4.0),
            ("2017-10-03T00:00:00", 0, 0, 5.0),
        ],
    )
    values = lambda d: sorted(r.value for r in d.collect())
    assert values(select.slice_time(df, "2017-10-01", "2017-10-02")) == [2.0, 3.0, 4.0]
    assert values(select.slice_time(df, "2017-10-01", "2017-10-02T23:00:00")) == [2.0, 3.0, 4.0]
    assert values(select.slice_time(df, "2017-10-01", datetime(2017, 10, 2, 23))) == [2.0, 3.0]
    assert values(select.slice_time(df, end="2017-09")) == [1.0]
    assert values(select.slice_time(df)) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_box_keeps_the_index_box_and_blanks_other_cells(spark):
    # A rotated grid: cell (0, 1) lies in the index box of the matches but out of bounds.
    cells = spark.createDataFrame(
        [(0, 0, 46.0, 10.0), (0, 1, 49.0, 11.0), (1, 0, 46.5, 10.2), (1, 1, 47.0, 11.2),
         (2, 0, 50.0, 10.4), (2, 1, 51.0, 11.4)],
        "iy INT, ix INT, lat DOUBLE, lon DOUBLE",
    )
    data = frames.field(spark, [[1, 2], [3, 4], [5, 6]])
    box = select.subset_box(data, cells, (46, 48), [10, 12])
    assert frames.as_dict(box, ["iy", "ix"]) == {
        (0, 0): 1.0, (0, 1): None, (1, 0): 3.0, (1, 1): 4.0
    }
    only = select.subset_box(data, cells, (46, 48), (10, 12), crop="cells")
    assert frames.as_dict(only, ["iy", "ix"]) == {(0, 0): 1.0, (1, 0): 3.0, (1, 1): 4.0}


def test_box_drops_grid_rows_without_a_match_in_between(spark):
    cells = frames.cells(spark, [46, 60, 47], [10, 11])
    data = frames.field(spark, [[1, 2], [3, 4], [5, 6]])
    box = select.subset_box(data, cells, (46, 47), (10, 11))
    assert sorted(frames.as_dict(box, ["iy", "ix"])) == [(0, 0), (0, 1), (2, 0), (2, 1)]


def test_box_bounds_are_checked(spark):
    cells = frames.cells(spark, [46], [10])
    with pytest.raises(TypeError):
        select.subset_box(cells, cells, 46, (10, 11))
    with pytest.raises(KeyError):
        select.subset_box(cells, cells, (46, 47), (10, 11), lat="latitude")


def test_members(spark):
    df = frames.ensemble(
        spark, [("2017-01-01", m, 0, 0, float(i)) for i, m in enumerate(["00", "01", "09"])]
    )
    ids = lambda d: sorted(r.member for r in d.collect())
    assert ids(select.select_members(df, ["00", "09"])) == ["00", "09"]
    assert ids(select.select_members(df, "01")) == ["01"]
    assert ids(select.select_members(df, None)) == ["00", "01", "09"]
    assert ids(select.select_members(df, [])) == ["00", "01", "09"]
    assert ids(select.select_members(df, ["00", "77"], check=False)) == ["00"]
    with pytest.raises(FAILS, match="not every member of .*77"):
        select.select_members(df, ["00", "77"]).collect()
    with pytest.raises(FAILS, match="not every member of .*77"):
        select.select_members(df, ["77"]).collect()
    for ids in (["77"], ["00", "77"]):
        with pytest.raises(FAILS, match="not every member of .*77"):
            aggregate_time(select.select_members(df, ids), "daily").collect()


UNKNOWN = [["77"], ["02", "77"]]


@pytest.mark.parametrize("ids", UNKNOWN)
def test_unknown_member_fails_whatever_follows(spark, ids):
    """No filter, join, projection or aggregation above the check removes it."""
    df = roles.ensemble(spark, SF_DIR)
    found = select.select_members(df, ids)
    weather = roles.weather(spark, SF_DIR)
    after = [
        masks.drop_missing(found), found.where("value > 0"), found.where("value < 0"), found.where("time < timestamp_ntz'1800-01-01'"),
        select.filter_weather(found, weather, [1, 2]), select.slice_time(found, "1996", "1997"), found.select("time"),
        found.groupBy("iy").count(), found.join(roles.cells(spark, SF_DIR), ["iy", "ix"]), select.select_members(found, ids[:1], check=False),
    ]
    for query in after:
        with pytest.raises(FAILS, match="not every member of .*77"):
            query.collect()
    with pytest.raises(FAILS, match="not every member of .*77"):
        found.count()
    assert select.select_members(df, ["02"]).where("value > 0").count() == df.where("member = '02' AND value > 0").count() > 0


@pytest.mark.parametrize("ids", UNKNOWN)
def test_unknown_member_fails_in_runs(spark, ids):
    model, truth = roles.ensemble(spark, SF_DIR), roles.reference(spark, SF_DIR)
    cells, weather = roles.cells(spark, SF_DIR), roles.weather(spark, SF_DIR)
    for more, extra in [({}, {}), ({}, {"ensemble_cells": cells, "reference_cells": cells}), ({"include_types": [1, 2]}, {"weather": weather})]:
        known = verification.verify(model, truth, verification.Selection(members=["02"], period="daily", **more), metrics=["RMSE"], collapse=["time", "lat", "lon"], **extra)
        assert known.count() == 1
        with pytest.raises(FAILS, match="not every member of .*77"):
            verification.verify(model, truth, verification.Selection(members=ids, period="daily", **more), metrics=["RMSE"], collapse=["time", "lat", "lon"], **extra).collect()


def test_member_check_scans_the_time_slice_only(spark, tmp_path):
    frames.ensemble(spark, [("2017-01-01", "00", 0, 0, 1.0)]).write.parquet(str(tmp_path / "e"))
    df = select.slice_time(spark.read.parquet(str(tmp_path / "e")), "2017-01")
    found = select.select_members(df, ["00"])
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    scans = plan.split("Batched: ")[1:]
    assert len(scans) == 2 and all("GreaterThanOrEqual(time" in x for x in scans)


ZONES = """
import sys
sys.path[:0] = [{root!r}, {tests!r}]
import compare
from pyspark.sql import SparkSession
import __spark_entry__ as entry_module
from gridverify.operators import select
from gridverify.operators.temporal import aggregate_time
spark = (
    SparkSession.builder.master("local[2]").config("spark.sql.session.timeZone", {session!r})
    .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
con = compare.connect({sf_dir!r})
for name in ("time_slice", "full_run"):
    found = entry_module.queries()[name](spark, {sf_dir!r})
    assert compare.differences(found, con, entry_module.oracle_sql()[name]) == [], name
plan = compare.plan(entry_module.queries()["time_slice"](spark, {sf_dir!r}))
assert "PushedFilters: [" in plan and "GreaterThanOrEqual(l_shipdate,1995-03-01T00:00" in plan, plan
"""


@pytest.mark.parametrize(
    "machine, session", [("America/New_York", "UTC"), ("UTC", "America/New_York"), ("Asia/Tokyo", "America/New_York")]
)
def test_time_bounds_do_not_depend_on_time_zones(machine, session):
    here = Path(__file__).resolve().parent
    code = ZONES.format(root=str(here.parent), tests=str(here), session=session, sf_dir="/root/testdata/sf0.001")
    run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"TZ": machine}, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr[-2000:]


def test_times_with_a_zone_are_refused():
    with pytest.raises(ValueError, match="time zone"):
        select.time_span(datetime(2017, 1, 1, tzinfo=timezone.utc))


def test_weather_days(spark):
    weather = frames.weather(
        spark,
        [("2017-10-01T11:00:00", 6), ("2017-10-02T11:00:00", 3), ("2017-10-02T12:00:00", 6),
         ("2017-10-03T11:00:00", 1)],
    )
    df = frames.reference(
        spark,
        [("2017-10-01T00:00:00", 0, 0, 1.0), ("2017-10-01T23:00:00", 0, 0, 2.0),
         ("2017-10-02T05:00:00", 0, 0, 3.0), ("2017-10-03T05:00:00", 0, 0, 4.0),
         ("2017-10-04T05:00:00", 0, 0, 5.0)],
    )
    kept = lambda types: sorted(
        r.value for r in select.filter_weather(df, weather, types).collect()
    )
    assert kept([6]) == [1.0, 2.0, 3.0]
    assert kept(["6"]) == [1.0, 2.0, 3.0]
    assert kept([1, "3"]) == [3.0, 4.0]
    assert kept([9]) == []
    assert kept([]) == kept(None) == [1.0, 2.0, 3.0, 4.0, 5.0]
    for as_type in ("double", "string"):
        other = weather.withColumn("slwt", weather["slwt"].cast(as_type))
        days = select.included_days(other, [3]).collect()
        assert [r.day for r in days] == [date(2017, 10, 2)]
