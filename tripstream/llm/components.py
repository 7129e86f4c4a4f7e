"""Connected components of an edge table: a spanning forest in every partition, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a - b, sorted, and beside each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[i], root[j]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def spanned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (smallest node, node) that connect what the edges a - b connect: fewer than there are nodes."""
    nodes, roots = forest(a, b)
    inner = nodes != roots
    return np.column_stack([roots[inner], nodes[inner]])


def _spanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = np.empty((0, 2), np.int64)
    for b in batches:
        both = np.concatenate([held, b[["a", "b"]].to_numpy(np.int64)])
        held = spanned(both[:, 0], both[:, 1])
    yield pd.DataFrame({"u": held[:, 1], "v": held[:, 0]})


def _least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with the least of u and its partners beside each; a hot u is summed before the shuffle and its join can be split."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node on an edge (a, b) of longs that is no self-loop; root is its component's smallest node.

    Edges with a null end are left out; self-loops and repeats do no harm; no edges give no rows. Each partition
    of edges is first cut down to a spanning forest, so that a hot component brings an edge per partition and node
    at most. Each round writes its edges to the shared folder and deletes those of the one before: lost executors
    cost one round at most, and the disk holds two rounds.
    """
    flat = edges.select("a", "b").dropna().filter("a != b")
    now = cut(flat.mapInPandas(_spanned, "u long, v long").distinct())
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        after = cut(small.filter("u != v").distinct())
        forget(now)
        now = after
        # at rest: every node points at one root, and roots point nowhere
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("out")).union(now.select(F.col("v").alias("x"), F.lit(0).alias("out")))
        sums = ends.groupBy("x").agg(F.sum("out").alias("outs"), F.min("out").alias("low"))
        if not sums.filter("outs > 1 or (outs = 1 and low = 0)").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    out.cut_path = now.cut_path
    return out
