"""Nearest neighbours by a block matrix join.

Unit vectors are rounded to int8 with a scale and the exact length of their
rounding error each. The product of a tile of query and candidate blocks then
gives every cosine to within a proven bound; only pairs that may still be among
the nearest are computed again in double precision from the original vectors.
Heaps keep a query's nearest through the tiles of a task, and a last merge takes
the best of all tasks. The result is exact.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of unlike length are not compared; a query has
fewer neighbours than asked for if there are fewer candidates; ties go to the
smaller id. Repeated ids and rows are candidates of each other; rows with a null
id are candidates that rank last among equals.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridverify.llm.common import staged

#: Bytes of vectors in a block; blocks of candidates, and of queries, that meet in one task.
BLOCK_BYTES, BAND_BLOCKS, GROUP_BLOCKS = 1 << 20, 32, 8
#: Up to so many candidate blocks each is a task of its own.
FEW_BLOCKS = 32
#: Products are exact in single precision over so many components.
EXACT_COMPONENTS = 1024

_BLOCK = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("null_ids", pa.binary()), ("vectors", pa.binary()), ("coded", pa.binary()), ("scales", pa.binary()), ("errors", pa.binary())])
_BLOCK_TYPE = "block long, dim int, rows binary, ids binary, null_ids binary, vectors binary, coded binary, scales binary, errors binary"
RESULT = "query_row long, query_id long, row long, vec_id long, score double"
_RESULT = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the unit vectors, their scales, and bounds of the lengths of what rounding lost."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    lost = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes.astype(np.int8), scale, lost + 1e-9


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows, summed from the first component to the last."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for k in range(a.shape[1]):
        x, y = a[:, k], b[:, k]
        dot += x * y
        aa += x * x
        bb += y * y
    return np.clip(dot / np.sqrt(aa * bb), -1, 1)


def _pack(batches):
    held: dict[int, list] = {}
    made = 0

    def block(dim):
        nonlocal made
        rows, ids, vectors = zip(*held.pop(dim))
        values = np.array(vectors, np.float64)
        codes, scale, lost = quantised(values)
        made += 1
        none = np.array([i is None for i in ids])
        return pa.RecordBatch.from_pylist(
            [{"block": rows[0], "dim": dim, "rows": np.array(rows, np.int64).tobytes(), "ids": np.array([i or 0 for i in ids], np.int64).tobytes(), "null_ids": none.tobytes(), "vectors": values.tobytes(), "coded": codes.tobytes(), "scales": scale.tobytes(), "errors": lost.tobytes()}],
            schema=_BLOCK,
        )

    for batch in batches:
        for row, i, v in zip(*(c.to_pylist() for c in batch.columns)):
            held.setdefault(len(v), []).append((row, i, v))
            if 8 * len(v) * len(held[len(v)]) >= BLOCK_BYTES:
                yield block(len(v))
    for dim in list(held):
        yield block(dim)


class _Block:
    def __init__(self, row: dict):
        n = len(row["rows"]) // 8
        self.dim = row["dim"]
        self.rows, self.ids = np.frombuffer(row["rows"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.none = np.frombuffer(row["null_ids"], bool)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
        self.codes = np.frombuffer(row["coded"], np.int8).reshape(n, -1).astype(np.float32)
        self.scales, self.errors = np.frombuffer(row["scales"], np.float64), np.frombuffer(row["errors"], np.float64)


def _bounds(q: _Block, c: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Cosines from the int8 codes, and how far off they can be."""
    product = np.zeros((len(q.rows), len(c.rows)))
    for k in range(0, q.dim, EXACT_COMPONENTS):
        product += q.codes[:, k : k + EXACT_COMPONENTS] @ c.codes[:, k : k + EXACT_COMPONENTS].T
    product *= q.scales[:, None] * c.scales[None, :]
    a, b = q.errors[:, None], c.errors[None, :]
    return product, a + b + 3 * a * b


def _tile(nearest: int):
    def tile(key, left, right):
        queries = [_Block(r) for r in left.to_pylist()]
        candidates = [_Block(r) for r in right.to_pylist()]
        out = []
        for q in queries:
            # Of each query a heap of (score, last id first, row), the worst on top.
            heaps: list[list] = [[] for _ in q.rows]
            floor = np.full(len(q.rows), -np.inf)
            for c in candidates:
                if c.dim != q.dim:
                    continue
                about, off = _bounds(q, c)
                own = q.rows[:, None] == c.rows[None, :]
                low = np.where(own, -np.inf, about - off)
                if low.shape[1] > nearest:
                    floor = np.maximum(floor, np.partition(low, -nearest, axis=1)[:, -nearest])
                i, j = np.nonzero((about + off >= floor[:, None]) & ~own)
                for part in range(0, len(i), 1 << 16):
                    a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
                    score = cosine(q.vectors[a], c.vectors[b])
                    for n, s, none, vec, row in zip(a.tolist(), score.tolist(), c.none[b].tolist(), c.ids[b].tolist(), c.rows[b].tolist()):
                        entry = (s, not none, -vec, -row)
                        if len(heaps[n]) < nearest:
                            heapq.heappush(heaps[n], entry)
                        elif entry > heaps[n][0]:
                            heapq.heapreplace(heaps[n], entry)
                full = [n for n, h in enumerate(heaps) if len(h) == nearest]
                floor[full] = np.maximum(floor[full], [heaps[n][0][0] - 1e-9 for n in full])
            for row, i, none, heap in zip(q.rows.tolist(), q.ids.tolist(), q.none.tolist(), heaps):
                out += [(row, None if none else i, -r, -v if some else None, s) for s, some, v, r in heap]
        columns = list(zip(*out)) or [()] * 5
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, _RESULT.types)], schema=_RESULT)

    return tile


def nearest_neighbours(
    vectors: DataFrame, queries: Column, nearest: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest other rows of each row for which ``queries`` holds."""
    v = F.col(vector_col)
    fit = (
        v.isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        v.cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("query"),
    ).where(F.coalesce(fit, F.lit(False)))
    kept = staged(rows, "vectors")
    candidates = staged(kept.select("row", "id", "v").mapInArrow(_pack, _BLOCK_TYPE), "candidates")
    asked = kept.where("query").select("row", "id", "v")
    # Few queries come from each task; together they fill blocks.
    size = asked.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * 8
    packed = asked.repartition(size // (BLOCK_BYTES * GROUP_BLOCKS) + 1, "row").mapInArrow(_pack, _BLOCK_TYPE)
    asking = staged(packed, "queries")
    n_candidates, n_queries = candidates.count(), asking.count()
    bands = n_candidates if n_candidates <= FEW_BLOCKS else max(FEW_BLOCKS, -(-n_candidates // BAND_BLOCKS))
    groups = -(-n_queries // GROUP_BLOCKS)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("block"), F.lit(max(n, 1))).cast("int")
    left = asking.withColumn("group", dealt(groups)).withColumn("band", every(bands))
    right = candidates.withColumn("band", dealt(bands)).withColumn("group", every(groups))
    keys = ("group", "band")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(nearest), RESULT)
    best = W.Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
