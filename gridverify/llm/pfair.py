"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks. With weight w, block k (from 0) of a source is
released at slot floor(k / w) and due by slot ceil((k + 1) / w); every slot takes
the released block that is due first. Weights are whole parts of a period, over
which the schedule repeats itself, so only one period is worked out and every
block of every source follows by division. Up to any slot, each source has had
its weight of the slots to within less than one block.

The horizon is the first slot whose source has no block left. With given weights a
mix ends there; later blocks have slots too, but are not in it. Without them it has
every row: slots of an exhausted source are passed over, and the sources that are
left go on in the ratio of their weights.

Edge cases: a null source is a source of its own; sources without a weight, or
with weight 0, have no slots; a table without rows gives none. Repeated rows and
ids are separate rows. The last block of a source may be short.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from gridverify.llm.common import staged

#: Rows of a block; slots of a period, unless there are more sources.
BLOCK_ROWS, PERIOD = 8, 1000
#: Without given weights, a source's weight is its number of rows to this power.
POWER = 0.7
#: More sources than this need given weights, of which there may be as many.
MAX_SOURCES = 10_000
#: Rows that are numbered together.
BUCKET_ROWS = 1024
PLAN = T.StructType().add("__source", "string").add("k", "long").add("at", "long").add("release", "long").add("deadline", "long")


def quotas(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole slots of a period for each weight: largest remainders, at least one each."""
    weights = {s: w for s, w in weights.items() if w > 0}
    if all(float(w).is_integer() for w in weights.values()) and sum(weights.values()) <= period:
        common = math.gcd(*(int(w) for w in weights.values())) if weights else 1
        return {s: int(w) // common for s, w in weights.items()}
    period = max(period, 2 * len(weights))
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {s: w / total * spare for s, w in weights.items()}
    found = {s: 1 + int(x) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    for s in by_rest[: period - sum(found.values())]:
        found[s] += 1
    return found


def schedule(quota: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) over one period, earliest deadline first."""
    period = sum(quota.values())
    release = lambda s, k: k * period // quota[s]
    deadline = lambda s, k: -(-(k + 1) * period // quota[s])
    waiting = [(0, s, 0) for s in sorted(quota)]
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, k), s, k))
        due, s, k = heapq.heappop(ready)
        out.append((s, k, slot, release(s, k), due))
        if k + 1 < quota[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))
    return out


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def scheduled(
    documents: DataFrame, weights: dict | None = None, *, id_col: str = "doc_id", source_col: str = "source",
    block_rows: int = BLOCK_ROWS, period: int = PERIOD, power: float = POWER,
) -> DataFrame:
    """Columns ``row`` (the document), ``block``, ``release``, ``deadline``, ``slot``, ``place`` (in its block), ``in_mix``.

    Within a source the rows go in a random order given by their ids and their places in
    the table, so that null and repeated ids are spread out like others; the table must read
    the same each time. Rows of sources without a weight have no slot.
    """
    spark = documents.sparkSession
    rows = documents.select(
        source_key(F.col(source_col)).alias("__source"),
        F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(id_col), F.monotonically_increasing_id()), 11).alias("__at"),
        F.struct("*").alias("row"),
    )
    sizes = rows.groupBy("__source").agg(F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    n = {r["__source"]: r["n"] for r in sizes}
    if weights is None:
        wanted = {s: c**power for s, c in n.items()}
    else:
        wanted = {("" if s is None else f"={s}"): w for s, w in weights.items()}
        wanted = {s: w for s, w in wanted.items() if s in n}
    quota = quotas(wanted, period)
    length = sum(quota.values())
    plan = schedule(quota)
    at = {(s, k): slot for s, k, slot, _, _ in plan}
    blocks = {s: -(-n[s] // block_rows) for s in quota}
    horizon = min((blocks[s] // quota[s] * length + at[s, blocks[s] % quota[s]] for s in quota), default=0)

    # Numbers within a source: buckets of its random order, then rows within a bucket.
    known = T.StructType().add("__source", "string").add("buckets", "long").add("quota", "long")
    parts = spark.createDataFrame([(s, -(-c // BUCKET_ROWS), quota.get(s)) for s, c in n.items()], known)
    dealt = rows.join(F.broadcast(parts), "__source").withColumn(
        "__bucket", F.floor(F.col("__at") / F.lit(float(1 << 53)) * F.col("buckets"))
    )
    counts = dealt.groupBy("__source", "__bucket").agg(F.count("*").alias("c"))
    running = W.Window.partitionBy("__source").orderBy("__bucket").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = staged(
        counts.select("__source", "__bucket", F.coalesce(F.sum("c").over(running), F.lit(0)).alias("before")), "pfair"
    )
    inside = W.Window.partitionBy("__source", "__bucket").orderBy("__at", F.col("row")[id_col])
    numbered = dealt.withColumn("__number", F.row_number().over(inside) - 1).join(offsets, ["__source", "__bucket"])
    number = F.col("before") + F.col("__number")
    block = F.floor(number / block_rows)
    placed = numbered.select(
        "__source", "row", block.alias("block"), (number % block_rows).cast("int").alias("place"),
        (block % F.col("quota")).alias("k"), F.floor(block / F.col("quota")).alias("__round"),
    )
    steps = spark.createDataFrame(plan, PLAN)
    start = F.col("__round") * length
    return placed.join(F.broadcast(steps), ["__source", "k"], "left").select(
        "row", "block", (start + F.col("release")).alias("release"), (start + F.col("deadline")).alias("deadline"),
        (start + F.col("at")).alias("slot"), "place",
        F.coalesce(start + F.col("at") < horizon, F.lit(False)).alias("in_mix"),
    )


def mixed(documents: DataFrame, weights: dict | None = None, **options) -> DataFrame:
    """The documents of the mix, with their own columns, written in the order of the schedule.

    All documents, or with given weights those before the horizon.
    """
    found = scheduled(documents, weights, **options)
    if weights is not None:
        found = found.where("in_mix")
    ordered = found.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return ordered.select("row.*")
