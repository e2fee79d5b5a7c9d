"""Merkle manifest of a table: a tree per source, a tree of the sources above, proofs by butterfly exchange.

Each row is a leaf, the SHA-256 of its fields. Rows are numbered in their source and
cut into blocks of FANOUT ** LEVELS leaves that line up with the tree, so a block's
own hash is a node of the tree. Blocks then exchange nodes in rounds, one for each
level: every block fetches the nodes of its run from one block below each of them,
and hashes the run itself. All blocks below a node so work out the same hash, each has
the siblings of its whole path when the rounds end, and nothing is handed down. Of a run
that isn't full the fetches are spread over all blocks that hold the node. A round is a
join of one row per block and sibling; the leaves themselves move once, into their blocks.

Edge cases: null fields count as "-"; null ids come first in their source and equal ids
follow the order of their leaves; a null source is a source of its own and the first one;
repeated rows are leaves of their own; a source of one row is its own subroot, a table of
one source has its subroot as root; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.llm.common import numbered, small_batches, staged

#: Children of a node; levels that a block works out by itself.
FANOUT, LEVELS = 16, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields, each with its length in bytes before it."""
    texts = [f.cast("string") for f in fields]
    sized = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*sized), 256)


def lowered(text: Column) -> Column:
    return F.translate(text.cast("string"), UPPER, LOWER)


def _tree(leaves: list[str], whole: bool) -> list[list[str]]:
    """Levels of nodes from the leaves up: LEVELS of them above, or, of a whole source, until one node is left."""
    levels = [leaves]
    while (len(levels[-1]) > 1) if whole else (len(levels) <= LEVELS):
        below = levels[-1]
        levels.append([digest(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return levels


def _block_roots(batches):
    """Rows (g, block, blocks, members): the same with the block's own hash."""
    for batch in batches:
        out = []
        for blocks, members in zip(batch.column(2).to_pylist(), batch.column(3)):
            out.append(_tree(members.values.field("leaf").to_pylist(), blocks == 1)[-1][0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["g", "block", "blocks", "members", "node"])


def _round(state: DataFrame, place: Column, count: Column, partner, name: str) -> DataFrame:
    """One level up for the blocks whose level has more than one node.

    place and count: a block's node among those of its level; partner(j): number of the
    tree and block from which node j of that level is fetched.
    """
    first = place - place % FANOUT
    run = F.sequence(first, F.least(first + FANOUT, count) - 1)
    asked = state.where(count > 1).select("g", "block", place.alias("own"), F.explode(run).alias("j"))
    asked = partner(asked)
    held = state.select(F.col("g").alias("pg"), F.col("block").alias("pb"), F.col("node").alias("theirs"))
    got = asked.join(held, ["pg", "pb"]).groupBy("g", "block", "own").agg(F.array_sort(F.collect_list(F.struct("j", "theirs"))).alias("run"))
    side = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["theirs"]), "")
    up = got.select(
        "g", "block",
        F.sha2(F.array_join("run.theirs", ""), 256).alias("up"),
        F.struct(side(lambda x: x["j"] < F.col("own")).alias("before"), side(lambda x: x["j"] > F.col("own")).alias("after")).alias("siblings"),
    )
    joined = state.join(up, ["g", "block"], "left")
    return staged(
        joined.select(
            "g", "block", "blocks", F.coalesce("up", "node").alias("node"), "subroot",
            F.when(F.col("up").isNull(), F.col("proof")).otherwise(F.concat("proof", F.array("siblings"))).alias("proof"),
        ),
        name,
    )


def manifest(documents: DataFrame, altered: Column | None = None, *, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Stored blocks (g, block, members) and what each block knows in the end (g, block, blocks, subroot, root, proof).

    Members carry their place, id and leaf, and the leaf that is found instead of it where
    ``altered``, the leaf of a row as it is now, is not null.
    """
    spark = documents.sparkSession
    found = F.lit(None).cast("string") if altered is None else altered
    leaves = documents.select(
        F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"),
        leaf_digest([F.col(c) for c in columns]).alias("leaf"), found.alias("found"),
    )
    rows = numbered(staged(leaves, "merkle-leaves"), ["source"], ["id", "leaf"], "merkle-numbered")
    width = FANOUT**LEVELS
    rows = rows.withColumn("block", F.floor(F.col("pos") / width))
    sizes = rows.groupBy("source").agg(F.ceil(F.count("*") / width).alias("blocks"))
    trees = numbered(sizes, [], ["source"], "merkle-sources").withColumnRenamed("pos", "g")
    named = rows.alias("r").join(trees.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    members = F.array_sort(F.collect_list(F.struct("pos", "id", "leaf", "found"))).alias("members")
    packed = named.groupBy("g", "block", "blocks").agg(members)
    small_batches(spark)
    kind = packed.schema["members"].dataType.simpleString()
    blocks = staged(packed.mapInArrow(_block_roots, f"g long, block long, blocks long, members {kind}, node string"), "merkle-blocks")
    state = blocks.drop("members").withColumns(
        {"subroot": F.lit(None).cast("string"), "proof": F.expr("cast(array() as array<struct<before: string, after: string>>)")}
    )
    sources, most = state.agg(F.count_distinct("g"), F.coalesce(F.max("blocks"), F.lit(0))).first()

    span = 1
    while span < most:
        place, count = F.floor(F.col("block") / span), F.ceil(F.col("blocks") / span)

        def inside(asked: DataFrame, span=span) -> DataFrame:
            begin = F.col("j") * span
            there = F.least(F.lit(span), F.col("blocks") - begin)
            sized = asked.join(trees.select("g", "blocks"), "g")
            return sized.select("g", "block", "own", "j", F.col("g").alias("pg"), (begin + F.col("block") % span % there).alias("pb"))

        state = _round(state, place, count, inside, "merkle-round")
        span *= FANOUT
    state = state.withColumn("subroot", F.col("node"))

    span = 1
    while span < sources:
        place, count = F.floor(F.col("g") / span), F.lit(-(-sources // span))

        def across(asked: DataFrame, span=span) -> DataFrame:
            begin = F.col("j") * span
            there = F.least(F.lit(span), F.lit(sources) - begin)
            partner = asked.withColumn("pg", begin + F.col("g") % span % there)
            sized = partner.join(trees.select(F.col("g").alias("pg"), F.col("blocks").alias("theirs")), "pg")
            return sized.select("g", "block", "own", "j", "pg", (F.col("block") % F.col("theirs")).alias("pb"))

        state = _round(state, place, count, across, "merkle-round")
        span *= FANOUT
    return blocks, state.withColumnRenamed("node", "root")


def _siblings(levels: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For every node of a level that has one above it, what stands before and after it in its run."""
    out = []
    for nodes in levels[:-1]:
        sides = []
        for i in range(len(nodes)):
            first = i - i % FANOUT
            sides.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + FANOUT])))
        out.append(sides)
    return out


def fold(leaf: str, path: Sequence[tuple[str, str]]) -> str:
    """The root that follows from a leaf and the siblings of its path."""
    for before, after in path:
        leaf = digest((before, leaf, after))
    return leaf


_PROOFS = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]


def _proofs(batches):
    for batch in batches:
        for blocks, members, subroot, root, proof in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
            values = members.values
            leaves, found = values.field("leaf").to_pylist(), values.field("found").to_pylist()
            inner = _siblings(_tree(leaves, blocks == 1))
            upper = [(s["before"], s["after"]) for s in proof]
            proofs, folded = [], []
            for i, leaf in enumerate(leaves):
                path = [sides[i // FANOUT**k] for k, sides in enumerate(inner)] + upper
                proofs.append(digest([x for side in path for x in side]))
                folded.append(fold(found[i] or leaf, path))
            same = lambda x: pa.array(np.full(len(leaves), x, object), pa.string())
            yield pa.RecordBatch.from_arrays([values.field("id"), pa.array(leaves), same(subroot), same(root), pa.array(proofs), pa.array(folded)], names=["id", *_PROOFS])


def proofs(blocks: DataFrame, state: DataFrame) -> DataFrame:
    """Per row: id, leaf, subroot, root, SHA-256 of its siblings, and the root folded from the leaf that is found."""
    small_batches(blocks.sparkSession)
    known = blocks.select("g", "block", "blocks", "members").join(state.drop("blocks"), ["g", "block"])
    known = known.select("blocks", "members", "subroot", "root", "proof")
    kind = blocks.schema["members"].dataType.elementType["id"].dataType.simpleString()
    return known.mapInArrow(_proofs, f"id {kind}, " + ", ".join(f"{c} string" for c in _PROOFS))
