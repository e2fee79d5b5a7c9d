"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridverify.llm.common import staged

#: Links that a task contracts at a time.
LINKS = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node but the roots to its root, the smallest node that these links reach."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _contracted(batches):
    """Rows (a, b): stars with the same components as LINKS of them at a time."""
    held, size = [], 0

    def made():
        u, v = stars(*np.concatenate(held, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        size += batch.num_rows
        if size >= LINKS:
            yield made()
            held, size = [], 0
    if size:
        yield made()


def _lowest(edges: DataFrame, *more) -> DataFrame:
    """Smallest v of each u; stored, so that the join with it can split a u with many rows."""
    return staged(edges.groupBy("u").agg(F.min("v").alias("m"), *more), "components-min")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), both long; root is the smallest node of its component.

    Each round keeps at most as many links as before and only sums up neighbours, so
    a node with many links is one row per task; then tasks replace the links they hold by
    stars. It ends when every node has links to a single smaller node or to larger
    ones. Links of a node to itself and repeated links are allowed, nulls are not.
    """
    found = links.where("a != b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    below, above = F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above")
    while True:
        edges = staged(found.mapInArrow(_contracted, "u long, v long").distinct(), "components")
        upward = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = _lowest(edges.union(upward), below, above)
        if low.where("below > 1 or below = 1 and above > 0").isEmpty():
            return low.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = staged(upward.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "components")
        low = _lowest(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found = small.union(low.select("u", F.col("m").alias("v")))
