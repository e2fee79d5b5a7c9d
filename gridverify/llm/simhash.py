"""SimHash near-duplicates over a Gray-order hierarchical index.

Two 64-bit fingerprints that differ in at most three bits agree on one of four
16-bit parts. That shared, masked pattern is the top of the index: distinct
fingerprints are dealt by (part, value), and below it they are sorted by Gray
rank, so that neighbours share most bits. Runs of neighbours form nodes; a node
keeps the bits on which all its members agree and that its parent has not
already factored out. A search adds up differences on the way down and leaves a
whole node once they exceed the limit. Values of a part with more fingerprints
than one task should hold are cut into Gray-order blocks, and pairs of blocks
whose shared bits allow a link are searched one by one.

A task reports each fingerprint's link to the smallest one it reaches there, not
all pairs; the components of those links are the groups.

Edge cases: null, empty and blank texts have fingerprint zero and link like any
other; equal fingerprints are one group; null ids are kept and never smallest
unless all ids of a group are null; repeated rows are separate rows of the same
group. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridverify.llm.common import LOWER, buffers, free_names, small_batches, staged, utf8
from gridverify.llm.components import components

PARTS, LIMIT_BITS = 4, 3
#: Fingerprints of one part value that a task searches at once.
BLOCK_CODES = 8192
#: Members of a node, and pairs of fingerprint and node looked at at once.
FAN, FRONTIER = 8, 1 << 20


def fingerprint(text: bytes) -> int:
    """Majority bits of the XXH64 values of all word triples, as an unsigned number."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) < 3:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-3] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[2:].tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        values = np.array([fingerprint(t) for t in buffers(batch.column(1))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["row", "fp"])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over codes that are sorted by group and Gray rank."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        every = ~np.uint64(0)
        low, high, last = codes, codes, np.arange(len(codes))
        self.levels = []  # from the leaves up: pattern, shared bits, last code, children's bounds
        bounds = None
        while True:
            self.levels.append([low, ~(low ^ high), last, bounds])
            new = np.concatenate(([True], group[1:] != group[:-1]))
            if new.all():
                break
            place = np.arange(len(group))
            place = place - np.maximum.accumulate(np.where(new, place, 0))
            starts = np.flatnonzero(place % FAN == 0)
            ends = np.append(starts[1:], len(group))
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            last, group, bounds = last[ends - 1], group[starts], (starts, ends)
        # What the parent has factored out already is not counted again.
        self.roots = len(group)
        for k in range(len(self.levels) - 1):
            starts, ends = self.levels[k + 1][3]
            above = np.repeat(self.levels[k + 1][1], ends - starts)
            self.levels[k].append(self.levels[k][1] & ~above)
        self.levels[-1].append(self.levels[-1][1] & every)

    def pairs(self, codes: np.ndarray, roots: np.ndarray, later: bool):
        """(query, code) numbers at most LIMIT_BITS apart; later: only codes after the query's own."""
        top = len(self.levels) - 1
        numbers = np.arange(len(codes))
        todo = [(top, numbers[i : i + FRONTIER], roots[i : i + FRONTIER], None) for i in range(0, len(codes), FRONTIER)]
        while todo:
            level, query, node, before = todo.pop()
            low, _, last, bounds, own = self.levels[level]
            differ = np.bitwise_count((codes[query] ^ low[node]) & own[node])
            total = differ if before is None else before + differ
            near = total <= LIMIT_BITS
            if later:
                near &= last[node] > query
            query, node, total = query[near], node[near], total[near]
            if level == 0:
                if len(query):
                    yield query, node
                continue
            starts, ends = bounds
            step = FRONTIER // FAN
            for i in range(0, len(query), step):
                q, n = query[i : i + step], node[i : i + step]
                size = ends[n] - starts[n]
                at = np.repeat(starts[n] - np.cumsum(size) + size, size) + np.arange(size.sum())
                todo.append((level - 1, np.repeat(q, size), at, np.repeat(total[i : i + step], size)))


def joined(n: int, pairs) -> np.ndarray:
    """The smallest number that each of n is linked to, directly or not."""
    parent = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = parent[a], parent[b]
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return parent


def _links(codes: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    other = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays(
        [pa.array(codes[other].view(np.int64)), pa.array(codes[root[other]].view(np.int64))], names=["a", "b"]
    )


def _search_groups(batches):
    """Rows (key, fp), sorted by key: links within each key, some keys at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def links(key, fp):
        codes = fp.view(np.uint64)
        order = np.lexsort((gray_rank(codes), key))
        key, codes = key[order], codes[order]
        index = GrayIndex(key, codes)
        group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1])))
        return _links(codes, joined(len(codes), index.pairs(codes, group, True)))

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= 1 << 17:
            key, fp = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if whole:
                yield links(key[:whole], fp[:whole])
                held, size = [(key[whole:], fp[whole:])], len(key) - whole
    if size:
        yield links(*(np.concatenate(x) for x in zip(*held)))


def _cut_blocks(batches):
    """Rows (key, rank, fp), sorted: blocks of neighbours with their pattern and shared bits."""

    def block(key, codes):
        low, high = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
        shared = ~(low ^ high)
        return {"key": key, "id": int(codes.min().view(np.int64)), "pattern": int(low.view(np.int64)), "shared": int(shared.view(np.int64)), "codes": codes.tobytes()}

    key, held = None, []

    def flush():
        return pa.RecordBatch.from_pylist([block(key, np.array(held, np.int64).view(np.uint64))], schema=_BLOCK)

    for batch in batches:
        for k, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (k != key or len(held) >= BLOCK_CODES):
                yield flush()
                held = []
            key = k
            held.append(fp)
    if held:
        yield flush()


_BLOCK = pa.schema([("key", pa.int32()), ("id", pa.int64()), ("pattern", pa.int64()), ("shared", pa.int64()), ("codes", pa.binary())])
_BLOCK_TYPE = "key int, id long, pattern long, shared long, codes binary"


def _search_blocks(batches):
    """Rows of two blocks: links between their codes, or within one block."""
    for batch in batches:
        for same, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            b = b[np.argsort(gray_rank(b))]
            index = GrayIndex(np.zeros(len(b), np.int8), b)
            if same:
                yield _links(b, joined(len(b), index.pairs(b, np.zeros(len(b), np.int64), True)))
            else:
                codes = np.concatenate((a, b))
                found = index.pairs(a, np.zeros(len(a), np.int64), False)
                yield _links(codes, joined(len(codes), ((x, y + len(a)) for x, y in found)))


def near_links(fingerprints: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs at most three bits apart; fp must be distinct."""
    width = 64 // PARTS
    part = lambda p: F.shiftrightunsigned("fp", p * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    keys = F.explode(F.array(*(F.lit(p << width).bitwiseOR(part(p)) for p in range(PARTS))))
    dealt = fingerprints.select(keys.alias("key"), "fp")
    sizes = staged(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    usual = dealt.join(sizes.where(F.col("n") <= BLOCK_CODES).select("key"), "key", "left_semi")
    links = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_search_groups, "a long, b long")
    large = sizes.where(F.col("n") > BLOCK_CODES).select("key")
    if large.isEmpty():
        return links
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    many = dealt.join(large, "key", "left_semi").select("key", "fp", rank.alias("rank"))
    # Gray ranks are unsigned; half of them come out negative, which only moves the cut.
    cut = many.repartitionByRange("key", "rank").sortWithinPartitions("key", "rank").select("key", "fp")
    blocks = staged(cut.mapInArrow(_cut_blocks, _BLOCK_TYPE), "simhash-blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    apart = F.col("a.pattern").bitwiseXOR(F.col("b.pattern")).bitwiseAND(F.col("a.shared")).bitwiseAND(F.col("b.shared"))
    heads = lambda x: x.select("key", "id", "pattern", "shared")
    near = (
        heads(blocks).alias("a").join(heads(blocks).alias("b"), "key")
        .where((F.col("a.id") <= F.col("b.id")) & (F.bit_count(apart) <= LIMIT_BITS))
        .select("key", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))
    )
    pairs = near.join(blocks.select("key", F.col("id").alias("a_id"), F.col("codes").alias("a_codes")), ["key", "a_id"])
    pairs = pairs.join(blocks.select("key", F.col("id").alias("b_id"), F.col("codes").alias("b_codes")), ["key", "b_id"])
    pairs = pairs.select((F.col("a_id") == F.col("b_id")).alias("same"), "a_codes", "b_codes")
    return links.union(pairs.mapInArrow(_search_blocks, "a long, b long"))


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, fp, first) per row: its fingerprint and the smallest (no id, id, row) of its group.

    row numbers the rows of the table, which must read the same each time.
    """
    small_batches(documents.sparkSession)
    numbered = documents.select(
        F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n")).alias("row"),
        utf8(F.col(text_col)).alias("text"),
    )
    kind = numbered.schema["row"].dataType.simpleString()
    rows = staged(numbered.mapInArrow(_fingerprints, f"row {kind}, fp long"), "simhash")
    distinct = staged(rows.groupBy("fp").agg(F.min("row").alias("first")), "simhash-distinct")
    # The tasks below handle numbers only, which may come in larger batches than texts.
    linked = components(near_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    grouped = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    best = staged(grouped.groupBy("root").agg(F.min("first").alias("best")), "simhash-groups")
    firsts = staged(grouped.join(best, "root").select("fp", F.col("best").alias("first")), "simhash-firsts")
    return rows.join(firsts, "fp").select("row", "fp", "first")


def clusters(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, and the smallest doc_id of the group."""
    found = near_duplicates(documents, id_col=id_col, text_col=text_col)
    return found.select(
        F.col("row.id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )


def one_of_each(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, of which no smaller id is in the same group."""
    number = free_names(documents.columns, ["row"])[0]
    found = near_duplicates(documents, id_col=id_col, text_col=text_col)
    first = found.where(F.col("row.n") == F.col("first.n")).select(F.col("row.n").alias(number))
    numbered = documents.withColumn(number, F.monotonically_increasing_id())
    return numbered.join(first, number, "left_semi").select(*documents.columns)
