"""Connected components by alternating stars (Kiveris et al. 2014): no task holds a component and nothing comes to the driver but counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links, ascending, and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]


def _in_one_task(batches):
    read = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if read:
        nodes, root = roots_of(*map(np.concatenate, zip(*read, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])


def connected_components(links: DataFrame, one_task: int = 1_000_000) -> DataFrame:
    """links: (a, b) of long, any order, repeats allowed. Gives (node, root) for each node with a link, where root is the component's smallest node.
    one_task: up to so many links (16 MB) are joined by one task; more go through rounds of stars, in which no task holds more than its share."""
    links = cut(links.where("a <> b").select("a", "b"), "links")
    if links.count() <= one_task:
        return links.repartition(1).mapInArrow(_in_one_task, "node long, root long")
    edges = cut(_down(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    state = _state(edges)
    while True:
        edges = cut(_small(_large(edges)), "links")
        new = _state(edges)
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = new


def _down(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") / 2**40).cast("long"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = both.join(least, both.a == least.u).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _down(moved)


def _small(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, edges.a == least.u).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return _down(moved.where("a <> b"))
