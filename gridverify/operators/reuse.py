"""Tables that are computed once and read several times."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The session's checkpoint folder, if every executor can reach it.

    A path without a scheme or on ``file:`` is taken for shared only where all
    executors run on one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return None
    local_path = "://" not in folder and not folder.startswith("hdfs:") or folder.startswith("file:")
    if local_path and not spark.sparkContext.master.startswith("local"):
        return None
    return folder


def reuse(df: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Compute a table once: a checkpoint if the session names a shared folder for it.

    Otherwise the table is cached, and recomputed where an executor is lost;
    ``unpersist`` releases it, and ``held`` gets it for that.
    """
    spark = df.sparkSession
    # A folder named after the session began is not in use yet.
    ready = shared_folder(spark) and spark.sparkContext.getCheckpointDir()
    return df.checkpoint() if ready else cached(df, held)


def cached(df: DataFrame, held: list[DataFrame] | None = None) -> DataFrame:
    """Cache a small table when it is first computed; ``held`` gets it unless it was cached before."""
    if df.storageLevel == StorageLevel.NONE:
        df = df.persist()
        if held is not None:
            held.append(df)
    return df
