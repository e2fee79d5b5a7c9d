"""Member ids in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two digits between an underscore and the file extension.
MEMBER_PATTERN = r"_(\d{2})\.[^.]+$"


def member_id(file_name: str | Column) -> Column:
    """Two-digit member id of a file name such as ``rain_20170101_08.parquet``.

    A name without one fails the query when the row is read.
    """
    name = F.col(file_name) if isinstance(file_name, str) else file_name
    found = F.regexp_extract(name, MEMBER_PATTERN, 1)
    return F.when(found != "", found).otherwise(
        F.raise_error(F.concat(F.lit("no member id in file name: "), name)).cast("string")
    )
