"""MinHash near-duplicates with odd sketches: sets of word shingles with a Jaccard similarity of LEAST or more.

Equal sets are one row first. Bands of minima propose pairs: BANDS bands of MINIMA minima
miss a pair at the least similarity once in some million times. All minima of a set are also
folded into an odd sketch, a bitmap in which each sample flips one bit. The bits in which
two sketches differ tell how many samples do, and pairs that differ in more than
MOST_BITS are dropped; the rest are compared by their whole sets.

Of a band with at most CROWD sets all pairs are proposed. In larger ones each set is paired
with the band's smallest node, and what that leaves apart goes an exact way: the sets of all bands whose members are not in one component
yet are joined by their rarest shingles. Two sets that are similar enough share one of the first
ones in any fixed order, and its places in both sets bound their sizes (prefix and positional
filters), so that what all texts of a template share proposes nothing. Lists of a shingle
are cut into blocks, and pairs of blocks are compared in tasks of their own. At first a pair
of blocks proposes the TRIED closest pairs of any two components; what they leave apart is
joined again, and then all pairs of different components are proposed whose sketches allow it.
So no link is lost to the size of a crowd.

Edge cases: a text of fewer words than a shingle is one shingle; texts without words and nulls
are linked with nothing and are components of their own; null ids are kept and never the smallest
unless all ids of a component are null; repeated rows are separate rows of the same component;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.llm.common import LOWER, broadcast, buffers, received, small_batches, staged, utf8
from gridverify.llm.components import components

#: Words of a shingle; least similarity in hundredths.
WIDTH, LEAST = 2, 80
BANDS, MINIMA, SKETCH_BITS = 28, 4, 512
SAMPLES = BANDS * MINIMA
#: Sets of a band that are all paired; nodes that are broadcast to find their texts.
CROWD, BROADCAST_NODES = 16, 1 << 21
#: Slots in which the crowds' shingles are counted; entries of a block; pairs of two components that it proposes at first.
SLOTS, BLOCK, TRIED = 1 << 20, 512, 2
#: Standard deviations by which a sketch may be off before a pair is lost.
SIGMAS = 5


def _most_bits() -> int:
    share, odd = LEAST / 100, 1 - 2 / SKETCH_BITS
    unlike = 2 * SAMPLES * (1 - share)
    mean = SKETCH_BITS / 2 * (1 - odd**unlike)
    drawn = (2 * odd**unlike) ** 2 * SAMPLES * share * (1 - share)
    folded = SKETCH_BITS / 4 * (1 - odd ** (2 * unlike))
    return int(mean + SIGMAS * (drawn + folded) ** 0.5)


MOST_BITS = _most_bits()
_DRAW = np.random.default_rng(13)
_XOR, _TIMES, _FOLD = (_DRAW.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) for _ in range(3))
_TIMES |= np.uint32(1)
_FOLD |= np.uint32(1)
_SHIFT = np.uint32(32 - (SKETCH_BITS.bit_length() - 1))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.empty(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts)))


def minima(found: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, ~np.uint32(0))
    low = found.astype(np.uint32)
    for i in range(0, len(low), 256):
        np.minimum(least, ((low[i : i + 256, None] ^ _XOR) * _TIMES).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    """A bitmap in which sample i with its minimum flips one bit."""
    mixed = (least ^ (least >> np.uint32(15))) * _FOLD
    bits = ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x9E3779B1) + _XOR) >> _SHIFT
    return np.packbits(np.bincount(bits, minlength=SKETCH_BITS) & 1).tobytes()


def differing_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two arrays of sketches, a sketch a row."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=1)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are LEAST or more alike."""
    if not len(a) or not len(b):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= LEAST * (len(a) + len(b) - both)


def _described(width: int):
    def described(batches):
        for batch in batches:
            rows = []
            for text in buffers(batch.column(1)):
                found = shingles(text, width)
                digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64)
                least = minima(found) if len(found) else None
                rows.append((int(digest[0]), int(digest[1]), len(found), [] if least is None else band_keys(least), b"" if least is None else odd_sketch(least)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), _DESCRIBED)] if rows else [pa.array([], t) for t in _DESCRIBED]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["row", "d1", "d2", "n", "bands", "sketch"])

    return described


_DESCRIBED = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]


def _sets(width: int):
    def sets(batches):
        for batch in batches:
            found = [shingles(t, width).tobytes() for t in buffers(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "words"])

    return sets


def _close(batches):
    """Rows (a, b, sketch of a, sketch of b): the pairs whose sketches differ little."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            near = pa.array(differing_bits(one, two) <= MOST_BITS)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])


def _alike(batches):
    """Rows (a, b, set of a, set of b): the pairs whose sets are alike."""
    for batch in batches:
        sets = ([np.frombuffer(x, np.uint64) for x in batch.column(i).to_pylist()] for i in (2, 3))
        near = pa.array([similar(x, y) for x, y in zip(*sets)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])


def _sizes_fit(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * LEAST


def _slot(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(17)) & np.uint64(SLOTS - 1)


def _counts(batches):
    """Sets: how many of them hold a shingle of each slot."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for words in buffers(batch.column(0)):
            np.add.at(total, _slot(np.frombuffer(words, np.uint64)).astype(np.int64), 1)
    used = np.flatnonzero(total)
    for i in range(0, len(used), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(used[i : i + (1 << 16)]), pa.array(total[used[i : i + (1 << 16)]])], names=["slot", "n"])


def prefix(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set, rarest first, and the largest size of a set that may share each as its first one.

    Shingles that no other set holds are left out.
    """
    n = len(found)
    often = counts[_slot(found).astype(np.int64)]
    order = np.lexsort((found, often))[: n - -(-LEAST * n // 100) + 1]
    place = np.arange(len(order))
    # What two sets of n and m shingles share is at least LEAST / (100 + LEAST) of n + m, and at most n - place.
    largest = ((100 + LEAST) * (n - place) - LEAST * n) // LEAST
    keep = often[order] > 1
    return found[order][keep], largest[keep]


def _entries(held):
    def entries(batches):
        counts = received(held)
        for batch in batches:
            out, sketches = [[], [], [], [], []], []
            for node, root, words, sketch in zip(*(c.to_pylist() for c in batch.columns)):
                found = np.frombuffer(words, np.uint64)
                first, largest = prefix(found, counts)
                for column, value in zip(out, (first.view(np.int64), np.full(len(first), node), np.full(len(first), root), np.full(len(first), len(found)), largest)):
                    column.append(value.astype(np.int64))
                sketches += [sketch] * len(first)
            columns = [pa.array(np.concatenate([*c, np.empty(0, np.int64)])) for c in out]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sketches, pa.binary())], names=["word", "node", "root", "n", "largest", "sketch"])

    return entries


def _cut_blocks(batches):
    """Sorted rows (word, n, root, node, largest, sketch): blocks of a word's entries with the bounds of their sizes and roots.

    A block is alone if its word has no other one: words that may go on in another task don't count.
    """
    word, held, first, whole = None, [], True, True

    def made(alone=False):
        rows = np.array([r[:4] for r in held], np.int64)
        n, root, _, largest = rows.T
        block = {"word": word, "id": int(rows[0, 2]), "low": int(n.min()), "high": int(n.max()), "largest": int(largest.max()), "alone": alone, "rows": rows.tobytes()}
        block |= {"root_low": int(root.min()), "root_high": int(root.max()), "sketches": b"".join(r[4] for r in held)}
        return pa.RecordBatch.from_pylist([block], schema=_BLOCK)

    for batch in batches:
        for w, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and w != word:
                yield made(whole and not first)
                held, first, whole = [], False, True
            elif len(held) >= BLOCK:
                yield made()
                held, whole = [], False
            word = w
            held.append(row)
    if held:
        yield made()


_BLOCK = pa.schema([(c, pa.int64()) for c in ("word", "id", "low", "high", "largest", "root_low", "root_high")] + [("alone", pa.bool_()), ("rows", pa.binary()), ("sketches", pa.binary())])


def _compare_blocks(limit: int | None):
    """Rows (same, rows and sketches of a, of b): pairs whose sizes fit, whose roots differ and whose sketches differ little.

    With a limit, so many of any two roots, the closest by their sketches.
    """

    def compare(batches):
        for batch in batches:
            found = [np.empty((2, 0), np.int64)]
            for same, a, a_bits, b, b_bits in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.frombuffer(x, np.int64).reshape(-1, 4) for x in (a, b))
                n, m = a[:, None, 0], b[None, :, 0]
                good = (m <= a[:, None, 3]) & (n <= b[None, :, 3]) & (100 * np.minimum(n, m) >= LEAST * np.maximum(n, m))
                good &= a[:, None, 1] != b[None, :, 1]
                one, two = np.nonzero(np.triu(good, 1) if same else good)
                x, y = (np.frombuffer(v, np.uint8).reshape(-1, SKETCH_BITS // 8) for v in (a_bits, b_bits))
                bits = np.concatenate([differing_bits(x[one[i : i + 8192]], y[two[i : i + 8192]]) for i in range(0, len(one), 8192)] or [np.empty(0, np.int64)])
                near = np.flatnonzero(bits <= MOST_BITS)
                one, two, bits = one[near], two[near], bits[near]
                if limit is not None and len(one):
                    low, high = np.minimum(a[one, 1], b[two, 1]), np.maximum(a[one, 1], b[two, 1])
                    order = np.lexsort((bits, high, low))
                    low, high = low[order], high[order]
                    new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
                    place = np.arange(len(order))
                    order = order[place - np.maximum.accumulate(np.where(new, place, 0)) < limit]
                    one, two = one[order], two[order]
                found.append(np.stack((np.maximum(a[one, 2], b[two, 2]), np.minimum(a[one, 2], b[two, 2]))))
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return compare


def crowd_pairs(crowd: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs (a, b) of (node, root, words, sketch) with different roots that may be alike.

    Without a limit all of them that are alike are there, but for what sketches lose.
    """
    spark = crowd.sparkSession
    counted = crowd.select("words").mapInArrow(_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    counts[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    held = broadcast(spark, counts)
    entries = crowd.select("node", "root", "words", "sketch").mapInArrow(_entries(held), "word long, node long, root long, n long, largest long, sketch binary")
    order = ["word", "n", "root", "node"]
    cut = staged(entries, "crowd-entries").repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "largest", "sketch")
    kind = "word long, id long, low long, high long, largest long, root_low long, root_high long, alone boolean, rows binary, sketches binary"
    blocks = staged(cut.mapInArrow(_cut_blocks, kind), "crowd-blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    apart = (F.col("a.root_low") != F.col("b.root_high")) | (F.col("a.root_high") != F.col("b.root_low"))
    fits = (F.col("a.largest") >= F.col("b.low")) & (F.col("b.largest") >= F.col("a.low"))
    fits &= (F.col("a.high") * 100 >= F.col("b.low") * LEAST) & (F.col("b.high") * 100 >= F.col("a.low") * LEAST)
    ordered = F.struct("a.low", "a.id") < F.struct("b.low", "b.id")
    # A block is compared with itself where it lies; only words of several blocks are joined.
    several = ~F.col("a.alone") & ~F.col("b.alone")
    both = a.join(b, F.col("a.word") == F.col("b.word")).where(several & apart & fits & ordered)
    pairs = both.select(F.lit(False).alias("same"), "a.rows", "a.sketches", F.col("b.rows").alias("r"), F.col("b.sketches").alias("s"))
    own = blocks.where("root_low != root_high").select(F.lit(True).alias("same"), "rows", "sketches", F.col("rows").alias("r"), F.col("sketches").alias("s"))
    return own.union(pairs).mapInArrow(_compare_blocks(limit), "a long, b long")


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(row, n, first) per row: the size of its set and the smallest (no id, id, row) of its component.

    row numbers the rows of the table, which must read the same each time.
    """
    small_batches(documents.sparkSession)
    texts = documents.select(
        F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n")).alias("row"),
        utf8(F.col(text_col)).alias("text"),
    )
    kind = texts.schema["row"].dataType.simpleString()
    rows = staged(texts.mapInArrow(_described(width), f"row {kind}, d1 long, d2 long, n long, bands array<long>, sketch binary"), "minhash")
    same = rows.where("n > 0").groupBy("d1", "d2")
    distinct = same.agg(F.min("row").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    distinct = staged(distinct.withColumn("node", F.col("first.n")), "minhash-distinct")

    # Pairs of small bands, and of each set of a larger one with its first. Bands of one set go at once.
    dealt = distinct.select("node", "n", F.explode("bands").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("lead")).where("size > 1")
    shared = staged(dealt.join(sizes, "key"), "minhash-shared")
    star = shared.where("node != lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    lists = shared.where(f"size between 3 and {CROWD}").groupBy("key").agg(F.collect_list(F.struct("node", "n")).alias("x"))
    lists = lists.select(F.explode("x").alias("one"), "x")
    fit = F.filter("x", lambda y: (y["node"] < F.col("one.node")) & _sizes_fit(y["n"], F.col("one.n")))
    small = lists.select(F.col("one.node").alias("a"), F.explode(fit).alias("two")).select("a", F.col("two.node").alias("b"))
    proposed = star.union(small).distinct()

    numbered = documents.select(F.monotonically_increasing_id().alias("node"), utf8(F.col(text_col)).alias("text"))
    sketches = distinct.select("node", "n", "sketch")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Sets of the texts with these nodes, a stored table; texts stay where they are if the nodes are few."""
        few = nodes.count() <= BROADCAST_NODES
        chosen = numbered.join(F.broadcast(nodes) if few else nodes, "node")
        return staged(chosen.mapInArrow(_sets(width), "node long, words binary"), "minhash-sets")

    def alike(close: DataFrame) -> DataFrame:
        """The pairs whose sets are alike."""
        sets = sets_of(staged(close.select("a").union(close.select("b")).distinct().toDF("node"), "minhash-ends"))
        both = close.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b")
        return staged(both.select("a", "b", "one", "two").mapInArrow(_alike, "a long, b long"), "minhash-links")

    both = proposed.join(sketches.toDF("a", "n", "one"), "a").join(sketches.toDF("b", "m", "two"), "b").where(_sizes_fit(F.col("n"), F.col("m")))
    links = alike(staged(both.select("a", "b", "one", "two").mapInArrow(_close, "a long, b long"), "minhash-close"))
    linked = staged(components(links), "minhash-roots")

    # Crowds that are not one component yet, by their rarest shingles.
    crowded = shared.where(F.col("size") > CROWD).select("key", "node")
    for limit in (TRIED, None):
        rooted = crowded.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        crowd = staged(rooted.join(apart, "key", "left_semi").select("node", "root").distinct(), "minhash-apart")
        if crowd.isEmpty():
            break
        whole = sets_of(crowd.select("node")).join(crowd, "node").join(distinct.select("node", "sketch"), "node")
        more = alike(staged(crowd_pairs(staged(whole, "minhash-crowd"), limit).distinct(), "minhash-close"))
        if not more.isEmpty():
            linked = staged(components(linked.toDF("a", "b").union(more)), "minhash-roots")

    groups = distinct.select("d1", "d2", "first", "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = groups.groupBy("root").agg(F.min("first").alias("best"))
    firsts = staged(groups.join(best, "root").select("d1", "d2", "best"), "minhash-firsts")
    found = rows.select("row", "n", "d1", "d2").join(firsts, ["d1", "d2"], "left")
    return found.select("row", "n", F.when(F.col("n") > 0, F.col("best")).otherwise(F.col("row")).alias("first"))


def clusters(documents: DataFrame, **options) -> DataFrame:
    """doc_id, the size of its set, the smallest doc_id of its component, and whether that is its own."""
    found = near_duplicates(documents, **options)
    return found.select(
        F.col("row.id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"),
        F.col("row.id").eqNullSafe(F.col("first.id")).alias("kept"),
    )
