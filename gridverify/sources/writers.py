"""Writers for scores and processed data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridverify.operators.metrics import to_long
from gridverify.schema import CELL, dimension_columns, present, require


def write_scores(scores: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Save scores, domain-wide and per band, in one folder per metric."""
    long = scores if "metric" in scores.columns else to_long(scores)
    long.write.mode(mode).partitionBy("metric").parquet(path)


def write_grid(
    df: DataFrame,
    path: str,
    *,
    time: str | None = "time",
    files_per_month: int | None = None,
    gather: bool = True,
    mode: str = "overwrite",
) -> None:
    """Save gridded data in one folder per year and month, which time slices then skip.

    Rows are gathered by month, so that a month has as many files as its size
    asks for: Spark splits large months and puts small ones together, by its
    advisory partition size. ``files_per_month`` sets the number of tasks that
    write a month, spread by time and cell. ``gather=False`` writes each task's
    rows where they are, for data that already are in time order.
    """
    if time is None:
        df.write.mode(mode).parquet(path)
        return
    require(df, time)
    df = df.withColumns({"year": F.year(time), "month": F.month(time)})
    if files_per_month:
        spread = F.pmod(F.xxhash64(*present(df, (time, *CELL))), F.lit(files_per_month))
        df = df.repartition("year", "month", spread)
    elif gather:
        df = df.hint("rebalance", "year", "month")
    df.write.mode(mode).partitionBy("year", "month").parquet(path)


def write_cells(
    df: DataFrame, table: str, *, buckets: int, path: str | None = None, mode: str = "overwrite"
) -> None:
    """Save aggregated data as a catalogue table in which each cell is in one bucket.

    Tables of the same grid and number of buckets, read with ``read_cells``, are aggregated
    further, paired and scored per cell without another shuffle. Rows are first spread over the same
    buckets, so each is one file. The table must have one row per label, as aggregated
    data have: a cell then holds no more rows than there are times and members, however many
    values were measured there. ``path`` puts its files there.
    """
    require(df, *CELL)
    labels = dimension_columns(df)
    writer = df.repartition(buckets, *CELL).write.mode(mode).bucketBy(buckets, *CELL).sortBy(*CELL, *[c for c in labels if c not in CELL])
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
