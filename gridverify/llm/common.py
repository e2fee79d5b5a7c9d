"""What the operators share: folders, blocks of rows, tokens, splits."""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: Rows that Spark hands to Python at a time; texts may be long.
BATCH_ROWS = 200

_UPPER = bytes(range(65, 91))
LOWER = bytes(c + 32 if c in _UPPER else c for c in range(256))
#: Lower-cases A-Z and turns ASCII other than letters and digits into spaces.
WORDS_ONLY = bytes(
    c + 32 if c in _UPPER else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size, so that a batch of long texts fits in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read again."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _places(keys: int):
    """Sorted rows: the task's number, whether a row is of the task's first group, and its place in its group here."""

    def places(batches):
        part, before, lead, place = TaskContext.get().partitionId(), None, True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for column in batch.columns[:keys]:
                empty = column.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= empty[1:] != empty[:-1]
                unlike = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
                new[1:] |= unlike.to_numpy(zero_copy_only=False)
            first = [column[0].as_py() for column in batch.columns[:keys]]
            if before is not None and first != before:
                new[0] = True
            if new[0]:
                place = 0
            starts = np.flatnonzero(new)
            leads = np.zeros(batch.num_rows, bool)
            if lead:
                leads[: starts[0] if len(starts) else batch.num_rows] = True
                lead = not len(starts)
            rows = np.arange(batch.num_rows)
            at = np.maximum.accumulate(np.where(new, rows, 0))
            found = rows - at + np.where(np.cumsum(new) == 0, place, 0)
            place, before = int(found[-1]) + 1, [column[-1].as_py() for column in batch.columns[:keys]]
            more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(leads), pa.array(found.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "lead", "place"])

    return places


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """The rows with ``pos``, their place from 0 in their group, nulls first; equal rows in any order.

    The whole table is sorted and cut evenly, so a group may take many tasks; what
    earlier tasks hold of a task's first group is added, a number for each task. The
    rows are read twice and should be stored. Columns part, lead and place must be free.
    """
    tie = free_names(rows.columns, ["tie"])[0]
    first = [*group, *(c for c in rows.columns if c not in group)]
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order, tie]]
    cut = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kind = T.StructType([*rows.select(*first).schema.fields, T.StructField("part", T.IntegerType()), T.StructField("lead", T.BooleanType()), T.StructField("place", T.LongType())])
    local = staged(cut.select(*first).mapInArrow(_places(len(group)), kind), name)
    of = F.struct(F.lit(0).alias("all"), *group)
    heads = local.where("lead and place = 0").select("part", of.alias("g"))
    sizes = (
        local.withColumn("g", of).join(F.broadcast(heads.select("g").distinct()), "g", "left_semi").groupBy("part", "g").agg(F.count("*").alias("n"))
    )
    running = W.Window.partitionBy("g").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    before = heads.join(sizes.select("part", "g", F.sum("n").over(running).alias("before")), ["part", "g"]).select("part", "before")
    earlier = F.when(F.col("lead"), F.coalesce("before", F.lit(0))).otherwise(F.lit(0))
    placed = local.join(F.broadcast(before), "part", "left")
    return placed.select(*rows.columns, (F.col("place") + earlier).alias("pos"))


def broadcast(spark: SparkSession, value):
    """A broadcast of pickled bytes, classes of this package included; see received()."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(held):
    return pickle.loads(held.value)


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % n


def utf8(text: Column) -> Column:
    return text.cast("binary")


def free_names(taken: list[str], names: list[str]) -> list[str]:
    """The names, with underscores appended to those that are taken, whatever their case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def buffers(column: pa.Array) -> list[bytes]:
    """The values of a binary column; null is empty."""
    return [v or b"" for v in column.to_pylist()]


def packed(a: np.ndarray) -> bytes:
    """Compressed numbers, all first bytes, then all second ones, and so on."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
