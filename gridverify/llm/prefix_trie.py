"""Prefix trie of conversations: double arrays per prefix shard, shared upper nodes merged globally.

A turn is known by a digest of role and text, a node by its depth and the XOR of its
turns' digests, each salted with its position; such keys add up along a conversation
whatever task holds which part. Conversations are cut into segments of SEGMENT turns.
Equal segments below the same node are one row with the number of their conversations,
and the rows are sorted by (node, turns) and cut into ranges: the prefix shards. A hot
prefix spans several shards, cut at deeper turns, and a long conversation has a segment
in many.

A shard numbers its turns densely and packs its segments into BASE and CHECK arrays,
PACK_TURNS turns at a time: the child of node s by turn t is BASE[s] + t if CHECK there
is s. Walking all segments through the arrays, one depth at a time, gives the nodes and
sums them up. A node that other shards may hold too, because it is on a shard's first or
last path or leads to another segment, gives partial sums, which meet by key; their sums
over subtrees follow by doubling the distance to the ancestor they are added to.

Edge cases: turns are ordered by number, null first, and turns of the same number by
digest; null roles and texts are empty; rows without a conversation are left out; repeated
rows are turns of their own; rebuilt conversations may have no turns and count for the
root; an empty table gives no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from gridverify.llm.common import numbered, staged

#: Turns of a segment; turns of a double array; heads that are shared have up to so many turns.
SEGMENT, PACK_TURNS, HEAD_TURNS = 64, 1 << 16, 3
#: Gaps that are looked at for a node of several children, and places tried in them.
GAPS, TRIES = 4096, 64
#: Conversations whose ids a task writes as one row.
CHUNK_IDS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a turn in a path: its digest, then its number of words.
ITEM = np.dtype([("a", ">u8"), ("b", ">u8"), ("words", ">i8")])
_STEPS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, item): the place of each turn and its digest and number of words in hex."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    words = F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 16, "0")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(digest, words).alias("item"))
    rows = staged(rows.where("conv_id is not null"), "trie-turns")
    return numbered(rows, ["conv_id"], ["turn", "item"], "trie-places").drop("turn")


def rebuilt(numbered_turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation and (conv_id, pos, item, length) of its turns.

    A conversation takes its first turns from the first one of its twenty.
    """
    sizes = numbered_turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD_TURNS + 1)).cast("int")
    first = numbered_turns.where(F.col("pos") < HEAD_TURNS)
    heads = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("head"))
    convs = sizes.select("conv_id", "own", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("base"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    none = F.expr("cast(array() as array<struct<pos: bigint, item: string>>)")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", none), 1, F.col("h")))
    length = F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = staged(convs.select("conv_id", "h", "head", length.cast("long").alias("length")), "trie-conversations")
    heads = convs.select("conv_id", "length", F.explode("head").alias("x")).select("conv_id", "x.pos", "x.item", "length")
    own = numbered_turns.join(convs.select("conv_id", "h", F.size("head").alias("n"), "length"), "conv_id")
    own = own.where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "item", "length")
    return convs.select("conv_id", "length"), heads.unionByName(own)


def salted(items: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Two numbers of each turn's digest and position."""
    out = np.empty((len(items), 2), np.uint64)
    for k, name in enumerate(("a", "b")):
        x = items[name].astype(np.uint64) + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, times in zip((30, 27), _STEPS):
            x = (x ^ (x >> np.uint64(shift))) * times
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def _keyed(batches):
    """Rows (conv_id, k, length, path): the same with the XOR of the path's turns."""
    for batch in batches:
        keys = []
        for k, path in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            items = np.frombuffer(path, ITEM)
            keys.append(np.bitwise_xor.reduce(salted(items, k * SEGMENT + np.arange(len(items))), axis=0))
        keys = np.array(keys, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=[*batch.schema.names, "x1", "x2"])


def segments(placed: DataFrame) -> DataFrame:
    """(conv_id, k, path, s1, s2, e1, e2, last): segments with the keys of the nodes that they start and end at."""
    of = placed.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("k"), "length")
    items = of.agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("x"))
    paths = items.select("conv_id", "k", "length", F.unhex(F.array_join("x.item", "")).alias("path"))
    keyed = staged(paths.mapInArrow(_keyed, "conv_id long, k long, length long, path binary, x1 long, x2 long"), "trie-segments")
    # Only conversations of several segments meet, with their keys alone, for the keys before a segment.
    along = W.Window.partitionBy("conv_id").orderBy("k").rowsBetween(W.Window.unboundedPreceding, -1)
    before = keyed.where(F.col("length") > SEGMENT).select("conv_id", "k", *(F.coalesce(F.bit_xor(f"x{i}").over(along), F.lit(0)).alias(f"s{i}") for i in (1, 2)))
    starts = keyed.join(before, ["conv_id", "k"], "left")
    starts = starts.withColumns({f"s{i}": F.coalesce(f"s{i}", F.lit(0).cast("long")) for i in (1, 2)})
    last = (F.col("k") + 1) * SEGMENT >= F.col("length")
    ends = [F.col(f"s{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"e{i}") for i in (1, 2)]
    return starts.select("conv_id", "k", "length", "path", "s1", "s2", *ends, last.alias("last"))


class DoubleArray:
    """BASE and CHECK over paths of dense labels; state 0 is the root."""

    def __init__(self, labels: np.ndarray, lengths: np.ndarray):
        """labels: a path a row, of which the first ``lengths`` numbers count; rows with a common start are neighbours."""
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -1)
        self.size, self.gaps = 1, 1
        at = np.zeros(len(labels), np.int64)  # the state of each path so far
        for depth in range(labels.shape[1] if len(labels) else 0):
            going = np.flatnonzero(lengths > depth)
            if not len(going):
                break
            state, label = at[going], labels[going, depth]
            order = np.lexsort((label, state))
            parents, wanted = state[order], label[order]
            new = np.concatenate(([True], (parents[1:] != parents[:-1]) | (wanted[1:] != wanted[:-1])))
            self._place(parents[new], wanted[new])
            at[going] = self.base[state] + label

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1)))

    def _fit(self, wanted: np.ndarray) -> int:
        """A base for which all slots are free: one of some gaps, or behind the last slot in use."""
        low = max(self.gaps, int(wanted[0]))
        spots = low + np.flatnonzero(self.check[low : min(low + GAPS, self.size)] < 0)[:TRIES]
        if len(spots):
            slots = (spots - wanted[0])[:, None] + wanted
            inside = slots < self.size
            taken = (inside & (self.check[np.where(inside, slots, 0)] >= 0)).any(axis=1)
            if not taken.all():
                return int(spots[np.argmin(taken)] - wanted[0])
        return max(0, self.size - int(wanted[0]))

    def _place(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """A base for each parent of a level such that the slots of all its children are free."""
        starts = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        counts = np.diff(np.append(starts, len(parents)))
        single = counts == 1
        for a, n in zip(starts[~single].tolist(), counts[~single].tolist()):
            wanted = labels[a : a + n]
            base = self._fit(wanted)
            self._grow(base + int(wanted[-1]) + 1)
            self.base[parents[a]] = base
            self.check[base + wanted] = parents[a]
            self.size = max(self.size, base + int(wanted[-1]) + 1)
        lone = starts[single]
        if len(lone):
            # A single child fits any free slot not before its label: the next one, each slot once.
            self._grow(max(self.size, int(labels[lone].max())) + len(lone) + 1)
            free = 1 + np.flatnonzero(self.check[1:] < 0)
            order = np.argsort(labels[lone], kind="stable")
            wanted = labels[lone][order]
            first = np.searchsorted(free, wanted)
            slots = free[np.arange(len(first)) + np.maximum.accumulate(first - np.arange(len(first)))]
            self.base[parents[lone][order]] = slots - wanted
            self.check[slots] = parents[lone][order]
            self.size = max(self.size, int(slots.max()) + 1)
        left = np.flatnonzero(self.check[self.gaps : self.size] < 0)
        self.gaps = self.gaps + int(left[0]) if len(left) else self.size

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children of states by labels; -1 where there is none."""
        to = self.base[states] + labels
        inside = (to > 0) & (to < len(self.check))
        found = np.where(inside, to, 0)
        return np.where(inside & (self.check[found] == states), found, -1)


_NODES = [("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("n", pa.int64()), ("rep", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("shared", pa.bool_()), ("parent", pa.int64())]
NODES = "depth long, k1 long, k2 long, p1 long, p2 long, n long, rep long, children long, leaves long, saved long, words long, shared boolean, parent long"


def pack_nodes(k: np.ndarray, start: np.ndarray, paths: list[bytes], n: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
    """Nodes of some sorted segments; n, rep: number and smallest id of each one's conversations.

    Nodes that are not shared are complete. Of the others, children, leaves and saved count
    what hangs below them without further shared nodes; parent is null where that is shared.
    """
    lengths = np.array([len(p) // ITEM.itemsize for p in paths])
    items = np.frombuffer(b"".join(paths), ITEM)
    begins = np.cumsum(lengths) - lengths
    turn = np.arange(len(items)) - np.repeat(begins, lengths)
    depth = np.repeat(k * SEGMENT, lengths) + turn
    mixed = salted(items, depth)
    # Dense numbers: nodes that segments start at, then turns.
    new = np.concatenate(([True], (start[1:] != start[:-1]).any(axis=1) | (k[1:] != k[:-1])))
    group = np.cumsum(new) - 1
    # Turns are numbered as they first appear, depth by depth, so that children are close to each other.
    pairs = np.empty(len(items), [("a", np.uint64), ("b", np.uint64)])
    pairs["a"], pairs["b"] = items["a"], items["b"]
    raw = np.unique(pairs, return_inverse=True)[1].reshape(-1)
    seen, first = np.unique(raw[np.argsort(turn, kind="stable")], return_index=True)
    rank = np.empty(len(seen), np.int64)
    rank[seen[np.argsort(first)]] = np.arange(len(seen))
    width = int(lengths.max()) + 1
    labels = np.zeros((len(paths), width), np.int64)
    labels[:, 0] = group
    labels[np.repeat(np.arange(len(paths)), lengths), turn + 1] = group[-1] + 1 + rank[raw]
    trie = DoubleArray(labels, lengths + 1)
    slots = len(trie.check)

    # Walk all segments, one depth at a time.
    total, least = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    keys, words, level = np.zeros((slots, 2), np.uint64), np.zeros(slots, np.int64), np.full(slots, -1)
    state = np.zeros(len(paths), np.int64)
    shared, joint = np.zeros(slots, bool), np.zeros(slots, bool)
    by_depth = []
    edge = np.zeros(len(paths), bool)
    edge[[0, -1]] = True
    for d in range(width):
        going = np.flatnonzero(lengths + 1 > d)
        if not len(going):
            break
        to = trie.step(state[going], labels[going, d])
        if (to < 0).any():
            raise AssertionError("a packed path is missing")
        if d == 0:
            keys[to] = start[going]
            level[to] = k[going] * SEGMENT
        else:
            at = begins[going] + d - 1
            keys[to] = keys[state[going]] ^ mixed[at]
            level[to] = depth[at] + 1
            words[to] = items["words"][at]
            np.add.at(total, to, n[going])
            np.minimum.at(least, to, rep[going])
        state[going] = to
        shared[to[edge[going]]] = True
        by_depth.append(np.unique(to))
    joint[state[lengths == SEGMENT]] = True
    shared |= joint
    shared[by_depth[0]] = True
    for nodes in by_depth[:0:-1]:  # ancestors of shared nodes are shared
        shared[trie.check[nodes[shared[nodes]]]] = True

    children, leaves, saved = (np.zeros(slots, np.int64) for _ in range(3))
    for d in range(len(by_depth) - 1, 0, -1):
        nodes = by_depth[d]
        done = nodes[~shared[nodes]]
        leaves[done] += children[done] == 0
        saved[done] += (total[done] - 1) * words[done]
        up = trie.check[done]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[done])
        np.add.at(saved, up, saved[done])
    nodes = np.concatenate(by_depth)
    up = trie.check[nodes]
    root = np.isin(nodes, by_depth[0])
    signed = keys.view(np.int64)
    parent = lambda i: pa.array(signed[up, i], mask=root)
    columns = [
        pa.array(level[nodes]), pa.array(signed[nodes, 0]), pa.array(signed[nodes, 1]), parent(0), parent(1),
        pa.array(total[nodes]), pa.array(least[nodes], mask=root), pa.array(children[nodes]), pa.array(leaves[nodes]),
        pa.array(saved[nodes]), pa.array(words[nodes]), pa.array(shared[nodes]), pa.array(least[up], mask=root | shared[up]),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=pa.schema(_NODES))


def _packed(batches):
    """Sorted rows (k, s1, s2, path, n, rep): the nodes of PACK_TURNS turns at a time."""
    held, size = [], 0

    def made():
        k, s1, s2, paths, n, rep = zip(*held)
        start = np.stack((np.array(s1, np.int64), np.array(s2, np.int64)), axis=1).view(np.uint64)
        return pack_nodes(np.array(k, np.int64), start, list(paths), np.array(n, np.int64), np.array(rep, np.int64))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            size += len(row[3]) // ITEM.itemsize
            if size >= PACK_TURNS:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def _summed(shared: DataFrame) -> DataFrame:
    """Leaves and saved words of whole subtrees, from those that hang below each shared node alone.

    A node's sums cover all shared nodes less than 2 ** r levels below it after round r.
    """
    far = shared.agg(F.max("depth")).first()[0] or 0
    key, up = ["depth", "k1", "k2"], ["u1", "u2"]
    state = shared.select(*key, "leaves", "saved", F.col("p1").alias("u1"), F.col("p2").alias("u2"))
    step = 1
    while step <= far:
        named = state.where("u1 is not null")
        sent = named.groupBy((F.col("depth") - step).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"))
        sent = sent.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = state.select((F.col("depth") + step).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("v1"), F.col("u2").alias("v2"))
        state = state.join(sent, key, "left").join(further, ["depth", *up], "left")
        state = state.select(
            *key, (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            F.col("v1").alias("u1"), F.col("v2").alias("u2"),
        )
        state, step = staged(state, "trie-sums"), step * 2
    return state.select(*key, "leaves", "saved")


def _chunks(batches):
    """Sorted rows (depth, k1, k2, conv_id): runs of a node's ids, packed."""
    key, held = None, []

    def made():
        ids = np.array(held, np.int64)
        return pa.RecordBatch.from_pylist([{"depth": key[0], "k1": key[1], "k2": key[2], "first": held[0], "ids": ids.tobytes()}], schema=_CHUNK)

    for batch in batches:
        for depth, k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if held and ((depth, k1, k2) != key or len(held) >= CHUNK_IDS):
                yield made()
                held = []
            key = (depth, k1, k2)
            held.append(conv)
    if held:
        yield made()


_CHUNK = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])


def _hashed(batches):
    """Sorted chunks (depth, k1, k2, first, ids): the digest of each node's ids, chunk by chunk."""
    key, digest, out = None, None, []

    def flush():
        return pa.RecordBatch.from_pylist([dict(zip(("depth", "k1", "k2", "ends"), (*k, d))) for k, d in out], schema=_ENDS)

    for batch in batches:
        for depth, k1, k2, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, k1, k2) != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = (depth, k1, k2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode())
        if out:
            yield flush()
            out.clear()
    if key is not None:
        out.append((key, digest.hexdigest()))
        yield flush()


_ENDS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends", pa.string())])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends) from (depth, k1, k2, conv_id): the SHA-256 of each node's ids in order.

    Ids are sorted over all tasks; a task sends a node's ids as packed runs, so that the digest,
    which must be worked out in order, reads one row for many conversations.
    """
    key = ["depth", "k1", "k2"]
    cut = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    runs = cut.mapInArrow(_chunks, "depth long, k1 long, k2 long, first long, ids binary")
    return runs.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """Nodes: depth, key (k1, k2), rep, parent's rep, n, children, leaves, saved, ends."""
    convs, placed = rebuilt(turns(conversations))
    parts = staged(segments(placed), "trie-parts")
    distinct = parts.groupBy("k", "s1", "s2", "path").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep"))
    order = ["k", "s1", "s2", "path"]
    sorted_parts = staged(distinct, "trie-distinct").repartitionByRange(*order).sortWithinPartitions(*order)
    nodes = staged(sorted_parts.select(*order, "n", "rep").mapInArrow(_packed, NODES), "trie-nodes")

    # Shared nodes: partial sums by key; every conversation passes the root.
    key = ["depth", "k1", "k2"]
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).where("n > 0").select(*(F.lit(0).cast("long").alias(c) for c in key), "n", "rep")
    partial = nodes.where("shared").drop("shared", "parent").unionByName(root, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "children", "leaves", "saved")]
    others = [F.min("rep").alias("rep"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.coalesce(F.max("words"), F.lit(0)).alias("words")]
    merged = staged(partial.groupBy(*key).agg(*sums, *others), "trie-shared")
    kids = merged.where("p1 is not null").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more"))
    counted = merged.join(kids, key, "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    own = (F.col("n") - 1) * F.col("words")
    counted = staged(counted.withColumns({"leaves": F.col("leaves") + (F.col("children") == 0).cast("long"), "saved": F.col("saved") + own}).drop("more"), "trie-shared")
    merged = counted.drop("leaves", "saved").join(_summed(counted), key)

    of_parent = merged.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("rep").alias("parent"))
    whole = [*key, "rep", "n", "children", "leaves", "saved"]
    complete = nodes.where("not shared")
    top = complete.where("parent is null").select(*whole, "p1", "p2").unionByName(merged.select(*whole, "p1", "p2"))
    top = top.join(of_parent, ["depth", "p1", "p2"], "left").select(*whole, "parent")
    deep = complete.where("parent is not null").select(*whole, "parent")
    ended = parts.where("last").select(F.col("length").alias("depth"), F.col("e1").alias("k1"), F.col("e2").alias("k2"), "conv_id")
    zero = F.lit(0).cast("long")
    silent = convs.where("length = 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    ends = ends_digests(staged(ended.union(silent), "trie-ends"))
    return top.unionByName(deep).join(ends, key, "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit(b""), 256)))
