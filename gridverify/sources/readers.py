"""Readers for gridded data, terrain models and weather-type tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridverify.functions.names import MEMBER_PATTERN, member_id
from gridverify.functions.values import clean
from gridverify.operators.grid import rectilinear
from gridverify.operators.select import slice_time, subset_box, time_span
from gridverify.schema import dimension_columns, require, required


def read_grid(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    schema: T.StructType | None = None,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read one path or glob, or a list of them, as one long table.

    Rows carry their own coordinates, so files need no order. Give a schema to
    spare Spark the look into the files.
    """
    reader = spark.read.format(format).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    try:
        return reader.load([paths] if isinstance(paths, str) else list(paths))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no files match {paths}") from e


def _other_years(year: int, later: bool) -> list[str]:
    """Globs that match the years after a year, or before it."""
    digits = str(year)
    lengths = range(len(digits) + 1, 7) if later else range(1, len(digits))
    found = ["[0-9]" * n for n in lengths] + ([] if later else ["-*"])
    for k, digit in enumerate(map(int, digits)):
        low, high = (digit + 1, 9) if later else (0 if k else 1, digit - 1)
        if low <= high:
            found.append(f"{digits[:k]}[{low}-{high}]" + "[0-9]" * (len(digits) - k - 1))
    return found


def month_folders(start: str | date | datetime | None, end: str | date | datetime | None) -> list[str]:
    """Globs of the folders ``year=Y/month=M`` that hold the times from start to end.

    Folders of a year are looked up by name; with one end open, the years are listed.
    """
    first = time_span(start)[0] if start is not None else None
    last = time_span(end)[1] - timedelta(microseconds=1) if end is not None else None
    if first and last and first > last:
        return []

    def months(year: int) -> str:
        low = first.month if first and first.year == year else 1
        high = last.month if last and last.year == year else 12
        return f"year={year}/month={{{','.join(map(str, range(low, high + 1)))}}}"

    if first and last:
        return [months(year) for year in range(first.year, last.year + 1)]
    known = first or last
    if known is None:
        return ["year=*/month=*"]
    return [months(known.year), *(f"year={y}/month=*" for y in _other_years(known.year, later=first is not None))]


def read_months(
    spark: SparkSession,
    path: str,
    start: str | date | datetime | None = None,
    end: str | date | datetime | None = None,
    *,
    time: str = "time",
    schema: T.StructType | None = None,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """The times from start to end of a table with one folder per year and month, as ``write_grid`` saves it.

    Only the folders of the months in question are listed, where a path read as a whole
    and then sliced has all of its folders listed first. Bounds are those of
    ``slice_time``; without any the table is read whole, rows without a time included.
    """
    whole = {"schema": schema, "format": format, **options}
    if start is None and end is None:
        return read_grid(spark, path, **whole)
    base = path.rstrip("/")
    folders = month_folders(start, end)
    try:
        # One pattern for all, as a pattern of its own without a match would be an error.
        found = read_grid(spark, f"{base}/{{{','.join(folders)}}}", basePath=base, **whole)
    except FileNotFoundError:
        found = read_grid(spark, path, **whole).where(F.lit(False))
    return slice_time(found, start, end, time=time)


def read_cells(spark: SparkSession, *tables: str) -> list[DataFrame]:
    """Read tables saved by ``write_cells``, such that a pairing of them keeps their buckets.

    Spark shuffles both sides of a join on time and cell again where they lie by cell
    only, unless it is told that part of the keys will do. The tables belong to a session of
    their own with that setting and otherwise those of ``spark``, which stays as it is.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return [session.table(table) for table in tables]


def read_ensemble(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    schema: T.StructType | None = None,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read ensemble files and add the member named by each file.

    A file with rows and without a member in its name fails every query, also one that
    doesn't read the member; that costs a scan of the files' names. Tables that hold
    a ``member`` column, such as those partitioned by it, keep theirs.
    """
    df = read_grid(spark, paths, schema=schema, format=format, **options)
    if "member" in df.columns:
        return df
    unnamed = F.regexp_extract("_metadata.file_name", MEMBER_PATTERN, 1) == ""
    named = df.select(unnamed.alias("unnamed")).agg(F.count_if("unnamed") == 0)
    return required(df.withColumn("member", member_id("_metadata.file_name")), named, "no member id in file name")


def merge_by_coords(
    parts: Sequence[DataFrame], *, check_duplicates: bool = True
) -> DataFrame:
    """Merge blocks of rows by their coordinates: one row per label, with all variables.

    A variable that no block has at a label is NULL there. A duplicate is a label
    at which a variable has two values that are not missing: the query fails, also
    one that reads no variable, or takes the larger one without ``check_duplicates``.
    Of a selection by coordinates only the selected labels are checked.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    keys = dimension_columns(stacked)
    values = [c for c in stacked.columns if c not in keys]

    def one(name: str) -> Column:
        kind = stacked.schema[name].dataType
        value = clean(name) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(name)
        return value

    largest = [F.max(one(v)).alias(v) for v in values]
    if not check_duplicates:
        return stacked.groupBy(*keys).agg(*largest)
    counts = {f"{v} at one label": F.count(one(v)) for v in values}
    merged = stacked.groupBy(*keys).agg(*largest, *[n.alias(c) for c, n in counts.items()])
    # A filter, which no projection prunes.
    once = F.lit(True)
    for v, c in zip(values, counts):
        twice = F.raise_error(f"two values of {v} carry the same coordinates").cast("boolean")
        once = once & F.when(F.col(f"`{c}`") > 1, twice).otherwise(F.lit(True))
    return merged.where(once).drop(*counts)


def duplicate_labels(df: DataFrame) -> DataFrame:
    """Coordinates that occur more than once, with their number of rows."""
    keys = dimension_columns(df)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def prepare_dem(
    dem: DataFrame,
    dem_var: str = "ZH",
    *,
    lat_bounds: Sequence[float] | None = None,
    lon_bounds: Sequence[float] | None = None,
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Terrain table with ``altitude`` and axis coordinates, cropped if both bounds are given."""
    require(dem, dem_var)
    dem = dem.withColumnRenamed(dem_var, "altitude")
    if lat_bounds and lon_bounds:
        cells = dem.select("iy", "ix", lat, lon)
        # Cropping masks the data variable, not the geolocation.
        cropped = subset_box(
            dem.select("iy", "ix", "altitude"), cells, lat_bounds, lon_bounds, lat=lat, lon=lon
        )
        dem = cropped.join(cells, ["iy", "ix"])
    return rectilinear(dem, lat, lon)


def read_dem(
    spark: SparkSession, path: str, dem_var: str = "ZH", *, format: str = "parquet", **choices
) -> DataFrame:
    return prepare_dem(read_grid(spark, path, format=format), dem_var, **choices)


def read_weather_types(
    spark: SparkSession, path: str, *, date_col: str = "date", weather_type: str = "slwt"
) -> DataFrame:
    """Read a CSV file with a header as ``time, slwt``."""
    raw = spark.read.csv(path, header=True)
    require(raw, date_col, weather_type, error=KeyError)
    return raw.select(
        F.col(date_col).cast("timestamp_ntz").alias("time"),
        F.col(weather_type).cast("double").cast("int").alias("slwt"),
    )
