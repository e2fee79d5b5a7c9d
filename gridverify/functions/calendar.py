"""Calendar labels.

All of these read the wall-clock fields of a TIMESTAMP_NTZ or DATE column and
none goes through ``date_trunc``, which would make the label depend on the
session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def season(time: str | Column) -> Column:
    """DJF, MAM, JJA or SON."""
    m = F.month(_col(time))
    return (
        F.when(m.isin(12, 1, 2), "DJF")
        .when(m.isin(3, 4, 5), "MAM")
        .when(m.isin(6, 7, 8), "JJA")
        .when(m.isin(9, 10, 11), "SON")
    )


def year_end(time: str | Column) -> Column:
    return F.make_date(F.year(_col(time)), F.lit(12), F.lit(31))


def hour_start(time: str | Column) -> Column:
    """Start of the hour, as TIMESTAMP_NTZ."""
    t = _col(time)
    return F.to_date(t).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(t))


# Period -> (name of the label column or None for "keep the time column's name", label).
# Months and years are labelled with their last day; seasons pool all years.
_PERIODS = {
    "daily": (None, lambda t: F.to_date(t)),
    "monthly": (None, lambda t: F.last_day(t)),
    "seasonal": ("season", season),
    "yearly": (None, year_end),
}


def period_label(period: str, time: str = "time") -> tuple[str, Column] | None:
    """Name and expression of the label of ``period``; None if it is not a calendar period."""
    if period not in _PERIODS:
        return None
    name, label = _PERIODS[period]
    return name or time, label(F.col(time))


# Cycle type -> (name of the step column, step).
CYCLE_STEPS = {
    "diurnal": ("hour", lambda t: F.hour(t)),
    "daily": ("dayofyear", lambda t: F.dayofyear(t)),
    "monthly": ("month", lambda t: F.month(t)),
    "seasonal": ("season", season),
    "annual": ("year", lambda t: F.year(t)),
}


def cycle_step(cycle: str, time: str = "time") -> tuple[str, Column]:
    name, step = CYCLE_STEPS[cycle]
    return name, step(F.col(time))
