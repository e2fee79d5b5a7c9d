"""Shards of nearly equal bytes by sampled splitters.

Rows have a key, the hash of their text, and a size in bytes. A sample of keys,
drawn with a chance proportional to size, gives quantile boundaries; rows are
dealt to the ranges between them. A key that fills whole quantiles on its own is
a range of its own. Ranges are measured exactly, those that hold too much are
subdivided, by key or, where one key is too much for a shard, by row, and
runs of neighbouring ranges become shards. Equal texts therefore stay in one
shard unless they are more than a shard's part of all bytes. Within a shard rows are
numbered by range, or in the order of the table: each stretch of rows is
counted per shard, and its rows follow those of the stretches before.

Edge cases: a null text has no bytes and is a text of its own; sizes are never 0,
so a table of empty texts is shared out as well; repeated rows and ids, null ones
included, are separate rows, told apart by their places in the table, which must read the
same each time; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from gridverify.llm.common import broadcast, received, staged

#: Ranges to begin with: one for so many rows, within these bounds. Sampled keys per range.
RANGE_ROWS, RANGES, SAMPLES = 20_000, (1024, 16_384), 12
#: Neighbouring rows that are numbered together in the order of the table, as a power of two.
STRETCH_BITS = 12


def _splitters(rows: DataFrame, total: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted boundary keys, and the keys that fill at least a whole range alone."""
    wanted = ranges * SAMPLES
    # Drawn by a hash of key and id, so that a repeated task draws the same rows.
    chance = F.least(F.lit(1.0), F.col("size") * (wanted / max(1, total)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), "key", "id", "at"), 11) / F.lit(float(1 << 53))
    sample = rows.where(draw < chance).select("key", (F.col("size") / chance).alias("weight"))
    found = sample.groupBy("key").agg(F.sum("weight").alias("weight")).toPandas().sort_values("key")
    keys, weight = found["key"].to_numpy(np.int64), found["weight"].to_numpy(float)
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    heavy = keys[weight >= total / ranges]
    light = ~np.isin(keys, heavy)
    keys, weight = keys[light], weight[light]
    if not len(keys):
        return np.empty(0, np.int64), heavy
    at = np.searchsorted(np.cumsum(weight), np.arange(1, ranges) * (weight.sum() / ranges))
    return np.unique(keys[np.minimum(at, len(keys) - 1)]), heavy


def _assign(units: list, shards: int) -> dict[tuple, tuple[int, int]]:
    """Shard and first slot of each (range, piece): single keys first, then runs of ranges."""
    load, where = [0] * shards, {}
    for u in sorted((u for u in units if u.single), key=lambda u: (-u.bytes, u.range, u.piece)):
        s = min(range(shards), key=lambda i: (load[i], i))
        where[u.range, u.piece] = s
        load[s] += u.bytes
    s, rest = 0, sum(u.bytes for u in units)
    for u in sorted((u for u in units if not u.single), key=lambda u: (u.range, u.piece)):
        # Each shard aims at an even part of what it and the later ones will hold.
        while s < shards - 1 and load[s] + u.bytes / 2 > rest / (shards - s):
            rest -= load[s]
            s += 1
        where[u.range, u.piece] = s
        load[s] += u.bytes
    slots, out = [0] * shards, {}
    for u in sorted(units, key=lambda u: (u.range, u.piece)):
        s = where[u.range, u.piece]
        out[u.range, u.piece] = (s, slots[s])
        slots[s] += u.n
    return out


def _order(documents: DataFrame) -> tuple[Column, Column]:
    """A row's stretch and its place there, in the order in which the rows were written, or else come."""

    def stretch(part: Column, file: Column, row: Column) -> Column:
        return F.struct(part.alias("part"), file.alias("file"), F.shiftright(row, STRETCH_BITS).alias("stretch"))

    try:
        # Readers take files by size: the order of their rows is that of the tasks that wrote them.
        about = documents.metadataColumn("_metadata")
        part = F.regexp_extract(about["file_name"], r"^part-(\d{1,9})", 1).try_cast("long")
        found = stretch(F.coalesce(part, F.lit(-1)), about["file_path"], about["row_index"]), about["row_index"]
        documents.select(*found)
        return found
    except AnalysisException:
        place = F.monotonically_increasing_id()
        return stretch(F.lit(0), F.lit(""), place), place


def sharded(
    documents: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text",
    ranges: int | None = None, in_order: bool = False,
) -> DataFrame:
    """Columns ``row`` (the document), ``id``, ``size``, ``crc``, ``shard`` and ``slot``, which counts from 0 in each shard.

    ``in_order`` numbers the rows of a shard as they follow each other in the table.
    """
    spark = documents.sparkSession
    text = F.col(text_col).cast("string")
    rows = documents.select(
        F.struct("*").alias("row"),
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(text.isNull(), text).alias("key"),
        F.monotonically_increasing_id().alias("at"),
        *([c.alias(name) for c, name in zip(_order(documents), ("stretch", "place"))] if in_order else []),
    )
    light = rows.drop("row", "crc")
    n, total = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if ranges is None:
        ranges = min(RANGES[1], max(RANGES[0], n // RANGE_ROWS))
    bounds, heavy = _splitters(light, total, ranges)
    held = broadcast(spark, (bounds, heavy))
    fair, share = max(1, total // ranges), max(1, total // shards)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        bounds, heavy = received(held)
        keys = keys.to_numpy()
        found = np.searchsorted(bounds, keys, side="right")
        if len(heavy):
            place = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
            found = np.where(heavy[place] == keys, len(bounds) + 1 + place, found)
        return pd.Series(found.astype(np.int32))

    ranged = light.select("id", "size", "key", "at", range_of("key").alias("range"))
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("a"), F.max("key").alias("b")).collect()
    # Pieces of ranges that hold too much: of one key by id, of several by key.
    pieces = [(r.range, -(-r.bytes // fair) if r.bytes > 2 * fair else 1, r.a == r.b) for r in sums]
    cut = spark.createDataFrame(pieces, T.StructType().add("range", "integer").add("pieces", "long").add("single", "boolean"))

    def dealt(df):
        by = F.when(F.col("single"), F.xxhash64(F.lit(13), "id", "at")).otherwise(F.xxhash64(F.lit(13), "key"))
        named = df.withColumn("range", range_of("key")).join(F.broadcast(cut), "range")
        return named.withColumn("piece", F.pmod(by, F.col("pieces")).cast("int"))

    whole = {r.range for r in sums if r.a == r.b and r.bytes <= share}
    measured = dealt(light).groupBy("range", "piece", "single").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    units = _units(measured, whole)
    places = _assign(units, shards)
    known = T.StructType().add("range", "integer").add("piece", "integer").add("shard", "integer").add("before", "long")
    table = spark.createDataFrame(_rows(measured, places, whole), known)
    if in_order:
        shard_of = F.broadcast(table.drop("before"))
        counts = dealt(light).join(shard_of, ["range", "piece"]).groupBy("shard", "stretch").agg(F.count("*").alias("n"))
        running = W.Window.partitionBy("shard").orderBy("stretch").rowsBetween(W.Window.unboundedPreceding, -1)
        before = staged(counts.select("shard", "stretch", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before")), "shard-order")
        inside = W.Window.partitionBy("shard", "stretch").orderBy("place")
        found = dealt(rows).join(shard_of, ["range", "piece"]).withColumn("number", F.row_number().over(inside) - 1)
        found = found.join(before, ["shard", "stretch"])
        return found.select("row", "id", "size", "crc", "shard", (F.col("before") + F.col("number")).alias("slot"))
    inside = W.Window.partitionBy("range", "piece").orderBy("key", "id", "at")
    return (
        dealt(rows).withColumn("number", F.row_number().over(inside) - 1)
        .join(F.broadcast(table), ["range", "piece"])
        .select("row", "id", "size", "crc", "shard", (F.col("before") + F.col("number")).alias("slot"))
    )


class _Unit:
    """Rows that go to one shard: a piece of a range, or all pieces of a key that a shard can hold."""

    def __init__(self, range, piece, single, bytes, n):
        self.range, self.piece, self.single, self.bytes, self.n = range, piece, single, bytes, n


def _units(measured: list, whole: set[int]) -> list[_Unit]:
    units = {}
    for m in measured:
        piece = -1 if m.range in whole else m.piece
        u = units.setdefault((m.range, piece), _Unit(m.range, piece, m.single, 0, 0))
        u.bytes += m.bytes
        u.n += m.n
    return list(units.values())


def _rows(measured: list, places: dict, whole: set[int]) -> list[tuple]:
    """(range, piece, shard, first slot) of each piece."""
    done: dict[int, int] = {}
    out = []
    for m in sorted(measured, key=lambda m: (m.range, m.piece)):
        if m.range in whole:
            shard, start = places[m.range, -1]
            out.append((m.range, m.piece, shard, start + done.get(m.range, 0)))
            done[m.range] = done.get(m.range, 0) + m.n
        else:
            out.append((m.range, m.piece, *places[m.range, m.piece]))
    return out
