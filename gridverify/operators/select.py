"""Selections in space, time, member and weather type."""

from __future__ import annotations

import calendar
import re
from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridverify.operators.grid import GridSize, hinted, measure
from gridverify.schema import CELL, require, required, value_columns


# --- space -----------------------------------------------------------------


def mark_bounds(
    cells: DataFrame,
    lat_bounds: Sequence[float],
    lon_bounds: Sequence[float],
    *,
    lat: str = "lat",
    lon: str = "lon",
) -> DataFrame:
    """Add ``in_bounds`` to a cell table; both ends of both bounds are inside."""
    for bounds in (lat_bounds, lon_bounds):
        if not isinstance(bounds, (tuple, list)):
            raise TypeError(f"bounds must be a tuple or list, got {type(bounds).__name__}")
    require(cells, lat, lon, error=KeyError)
    inside = F.col(lat).between(*map(float, lat_bounds)) & F.col(lon).between(
        *map(float, lon_bounds)
    )
    return cells.withColumn("in_bounds", F.coalesce(inside, F.lit(False)))


def crop_to_box(df: DataFrame, marked: DataFrame, *, fits: bool) -> DataFrame:
    """Keep the grid rows and grid columns that hold at least one cell in bounds.

    The two lists are no longer than the grid's axes. They are broadcast if
    those ``fits``, so that the data are not shuffled.
    """
    inside = marked.where("in_bounds")
    for axis in CELL:
        df = df.join(hinted(inside.select(axis).distinct(), fits), axis, "left_semi")
    return df


def subset_box(
    df: DataFrame,
    cells: DataFrame,
    lat_bounds: Sequence[float],
    lon_bounds: Sequence[float],
    *,
    lat: str = "lat",
    lon: str = "lon",
    crop: str = "box",
    size: GridSize | None = None,
) -> DataFrame:
    """Crop data to a latitude/longitude box.

    ``crop="box"`` keeps every cell of the enclosing index box and sets the
    values of those outside the bounds to NULL, as a grid must stay
    rectangular; ``crop="cells"`` keeps only the cells in bounds. The ``size`` of
    the grid is measured by one small job if not given.
    """
    if crop not in ("box", "cells"):
        raise ValueError("crop must be 'box' or 'cells'")
    marked = mark_bounds(cells, lat_bounds, lon_bounds, lat=lat, lon=lon)
    size = size or measure({"grid": marked.withColumnsRenamed({lat: "lat", lon: "lon"})})["grid"]
    if crop == "cells":
        wanted = hinted(marked.where("in_bounds").select(*CELL), size.cells_fit)
        return df.join(wanted, list(CELL), "left_semi")
    flags = crop_to_box(marked, marked, fits=size.axes_fit).select(*CELL, "in_bounds")
    joined = df.join(hinted(flags, size.cells_fit), list(CELL))
    masked = {c: F.when(F.col("in_bounds"), F.col(c)) for c in value_columns(df)}
    return joined.withColumns(masked).select(*df.columns)


# --- time ------------------------------------------------------------------

_TIME_PARTS = re.compile(
    r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})(\.\d+)?)?)?)?)?)?$"
)


def time_span(when: str | date | datetime) -> tuple[datetime, datetime]:
    """First instant covered by a time label, and the first one after it.

    A text covers its own resolution: "2017-10" the whole month, "2017-10-02"
    the whole day, "2017-10-02T23:00:00" that second. Other values are instants.
    """
    if isinstance(when, datetime):
        if when.tzinfo is not None:
            raise ValueError(f"{when!r} has a time zone; times of the data have none")
        return when, when + timedelta(microseconds=1)
    if isinstance(when, date):
        first = datetime(when.year, when.month, when.day)
        return first, first + timedelta(days=1)
    found = _TIME_PARTS.match(when.strip())
    if not found:
        raise ValueError(f"cannot read time {when!r}")
    year, month, day, hour, minute, second, fraction = found.groups()
    first = datetime(
        int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0)
    )
    if fraction:
        first += timedelta(seconds=float("0" + fraction))
        step = timedelta(microseconds=1)
    elif second:
        step = timedelta(seconds=1)
    elif minute:
        step = timedelta(minutes=1)
    elif hour:
        step = timedelta(hours=1)
    elif day:
        step = timedelta(days=1)
    elif month:
        step = timedelta(days=calendar.monthrange(first.year, first.month)[1])
    else:
        step = timedelta(days=366 if calendar.isleap(first.year) else 365)
    return first, first + step


def _instant(when: datetime) -> Column:
    """Literal from text: through a datetime, two time zones would move it."""
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def slice_time(
    df: DataFrame,
    start: str | date | datetime | None = None,
    end: str | date | datetime | None = None,
    *,
    time: str = "time",
) -> DataFrame:
    """Keep ``start <= time <= end``; either end may be left open.

    If the table is partitioned by ``year`` and ``month``, the same bounds are
    also put on those columns, so that other months are not read (a table given
    by its path still lists all its folders; a catalogue can prune them first).
    """
    require(df, time, error=KeyError)
    partitioned = {"year", "month"} <= set(df.columns)
    year, month = F.col("year"), F.col("month")
    if start is not None:
        first = time_span(start)[0]
        df = df.where(F.col(time) >= _instant(first))
        if partitioned:
            df = df.where((year > first.year) | ((year == first.year) & (month >= first.month)))
    if end is not None:
        after = time_span(end)[1]
        df = df.where(F.col(time) < _instant(after))
        if partitioned:
            last = after - timedelta(microseconds=1)
            df = df.where((year < last.year) | ((year == last.year) & (month <= last.month)))
    return df


# --- member ----------------------------------------------------------------


def select_members(
    df: DataFrame, ids: Sequence[str] | str | None, *, member: str = "member", check: bool = True
) -> DataFrame:
    """Keep the given members; no ids keeps all of them.

    With ``check`` the query fails if an id does not occur, whatever is done with the
    result: a scalar subquery is worked out before the rows are read, and no later
    filter, join or projection removes it. That costs one scan of the member column
    alone; a table partitioned by member does not need it. Select in time and
    space first, as the check scans the table it is given.
    """
    if not ids:
        return df
    require(df, member, error=KeyError)
    wanted = sorted({ids} if isinstance(ids, str) else set(ids))
    chosen = F.col(member).isin(wanted)
    kept = df.where(chosen)
    if not check:
        return kept
    message = f"not every member of {wanted} occurs in the data"
    found = df.agg(F.count_distinct(F.when(chosen, F.col(member))).alias("n"))
    return required(kept, found.select(F.col("n") == len(wanted)), message)


# --- weather type ----------------------------------------------------------


def included_days(
    weather: DataFrame,
    include_types: Sequence[int | str],
    *,
    time: str = "time",
    weather_type: str = "slwt",
) -> DataFrame:
    """Days (column ``day``) with at least one row of a wanted weather type.

    Types are given as numbers or as texts; a text matches a type written like it.
    """
    kind = F.col(weather_type)
    texts = [t for t in include_types if isinstance(t, str)]
    numbers = [t for t in include_types if not isinstance(t, str)]
    if not isinstance(weather.schema[weather_type].dataType, T.NumericType):
        texts, numbers = [str(t) for t in include_types], []
    wanted = kind.cast("string").isin(texts) | kind.isin(numbers)
    return weather.where(wanted).select(F.to_date(time).alias("day")).distinct()


def filter_weather(
    df: DataFrame,
    weather: DataFrame,
    include_types: Sequence[int | str] | None = None,
    *,
    time: str = "time",
    weather_time: str = "time",
    weather_type: str = "slwt",
) -> DataFrame:
    """Keep every time step that falls on an included day; no types keeps all.

    The day list is broadcast: it holds distinct DATE values, of which there
    are 366 a year and at most 3.7 million in Spark's whole calendar, whatever
    the size of the data. So a day holding much of the data is never shuffled.
    """
    if not include_types:
        return df
    days = included_days(weather, include_types, time=weather_time, weather_type=weather_type)
    return df.join(F.broadcast(days), F.to_date(df[time]) == days["day"], "left_semi")
