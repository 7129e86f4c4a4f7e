"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors get one more coordinate, so that the largest inner product becomes the least Euclidean distance; tables of
p-stable hashes h(x) = floor((a . x + b) / width) cut space into buckets. A query visits, in every table, its own
bucket and then perturbed ones, in the order of their estimated chance to hold a neighbour. Candidates of all
tables are merged and ranked by their exact inner product.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, pick

TABLES = 16
HASHES = 14
#: Width of a bucket, as a share of the largest norm.
WIDTH = 2.8
PROBES = 300
#: Vectors in one index block, queries in one query block, and how many blocks' results are merged at once.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
FAN_IN = 64
SEED = 20


@lru_cache(8)
def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks among the 2 * hashes distances to bucket borders, by their expected score.

    Rank j stands for the j-th nearest border; the expected square of its distance for uniform positions is the
    score, and a set that takes both borders of one hash is no bucket. The empty set comes first.
    """
    m = hashes
    score = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap = [(score[0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - j not in chosen for j in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - score[last] + score[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + score[last + 1], (*chosen, last + 1)))
    return out


class Tables:
    """The hash functions, the same on every machine."""

    def __init__(self, dims: int, most: float, tables: int, hashes: int, width: float, probes: int):
        rng = np.random.default_rng(SEED)
        self.a = rng.normal(size=(tables, dims + 1, hashes))
        self.b = rng.uniform(0, 1, size=(tables, hashes))
        self.code = rng.integers(1, 1 << 62, size=hashes, dtype=np.int64) | 1
        self.most, self.width, self.sets = most, width * most, perturbations(hashes, probes)

    def at(self, x: np.ndarray, t: int, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and position in it, along each hash."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.most**2 - (x * x).sum(1)))
        f = (np.column_stack([x, rest]) @ self.a[t]) / self.width + self.b[t]
        low = np.floor(f)
        return low.astype(np.int64), f - low

    def keys(self, x: np.ndarray, t: int) -> np.ndarray:
        return (self.at(x, t, False)[0] * self.code).sum(1)

    def probes(self, x: np.ndarray, t: int) -> np.ndarray:
        """For each query its buckets' keys, in the order of their estimated success."""
        low, inside = self.at(x, t, True)
        home = (low * self.code).sum(1)
        gap = np.concatenate([inside, 1 - inside], 1)  # to the lower border, to the upper
        order = np.argsort(gap, axis=1, kind="stable")
        step = np.concatenate([-self.code, self.code])[order]
        return np.stack([home + step[:, list(s)].sum(1) for s in self.sets], 1)


def _usable(x) -> F.Column:
    """A vector of finite numbers that aren't all zero."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(x.isNull() | (F.size(x) == 0), False).otherwise(~bad & F.exists(x, lambda v: v != 0))


def exact(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products summed in one order, whatever else is in the block: equal vectors get equal scores."""
    return (v * q).sum(1)


def _best(k: int, tables: Tables, every: bool = False):
    """For each query the best of a block, among the vectors in the buckets it visits or among all."""

    def run(_key, rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            v, ids = np.array(rows["v"].tolist(), float), rows["vec_id"].to_numpy()
            q, names = np.array(asks["q"].tolist(), float), asks["query_id"].to_numpy()
            seen = np.full((len(q), len(v)), every)
            for t in range(0 if every else len(tables.a)):
                buckets, at = np.unique(tables.keys(v, t), return_inverse=True)
                probed = tables.probes(q, t)
                place = np.searchsorted(buckets, probed)
                hit = buckets[np.minimum(place, len(buckets) - 1)] == probed
                mask = np.zeros((len(q), len(buckets)), bool)
                who = np.broadcast_to(np.arange(len(q))[:, None], hit.shape)[hit]
                mask[who, place[hit]] = True
                seen |= mask[:, at]
            for i in range(len(q)):
                c = np.flatnonzero(seen[i])
                c = c[ids[c] != names[i]]
                if not len(c):
                    continue
                s = v[c] @ q[i]
                if len(c) > k:
                    least = np.partition(s, len(s) - k)[-k]
                    c = c[s >= least - 1e-9 * (1 + abs(least))]
                s = exact(v[c], q[i])
                top = np.lexsort((ids[c], -s))[:k]
                out.append((names[i], [{"neg": -float(s[j]), "vec_id": int(ids[c[j]])} for j in top], int(seen[i].sum())))
        return pd.DataFrame(out, columns=["query_id", "best", "looked"])

    return run


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES,
    block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score, looked): for the rows of vectors (vec_id, embedding) whose id is divisible by
    `every`, the k others of largest inner product that were found, nearest first, ties to the smaller vec_id.

    Null or zero vectors, those with a null or non-finite component or of another length than most have, and rows
    without vec_id take no part. A vec_id counts once; of several vectors the first in order counts. A query
    without candidates has no row. looked: how many vectors were compared for the query.

    Index and queries are cut into blocks of bounded size, and a block of vectors meets a block of queries in one
    task, which hashes both; a bucket that holds a third of all rows is spread over all blocks like any other.
    Every block gives one row of at most k neighbours per query; these are merged FAN_IN at a time.
    """
    src = pick(vectors, vec_id="long", embedding="array<double>").filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    src = cut(src.groupBy("vec_id").agg(F.min("embedding").alias("v")))
    shapes = src.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"))
    shape = shapes.orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not shape:
        return src.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, looked long")
    rows = src.filter(F.size("v") == shape[0].dims)
    asks = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    n_rows, n_asks = max(1, -(-shape[0].n // block_rows)), max(1, -(-asks.count() // block_queries))
    index = Tables(shape[0].dims, float(np.sqrt(shape[0].most)) * (1 + 1e-9), tables, hashes, width, probes)
    rows = rows.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)))
    schema = "query_id long, best array<struct<neg: double, vec_id: long>>, looked long"

    def merged(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"), F.sum("looked").alias("looked"))

    def found(asks: DataFrame, n_asks: int, every: bool) -> DataFrame:
        blocks = F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))
        some = asks.withColumn("a", F.pmod(F.xxhash64("query_id"), F.lit(n_asks)).cast("int")).withColumn("r", F.explode(blocks))
        dealt = rows.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
        out = dealt.groupBy("r", "a").cogroup(some.groupBy("r", "a")).applyInPandas(_best(k, index, every), schema)
        out, groups = out.withColumn("part", F.monotonically_increasing_id()), n_rows
        while groups > FAN_IN:
            groups = -(-groups // FAN_IN)
            out = merged(out.withColumn("part", F.pmod(F.xxhash64("part", "query_id"), F.lit(groups))), "query_id", "part")
        return merged(out, "query_id")

    best = cut(found(asks, n_asks, False))
    # queries whose buckets held fewer than there are to find meet all vectors
    full = best.filter(F.size("best") >= min(k, shape[0].n - 1)).select("query_id")
    short = cut(asks.join(full, "query_id", "left_anti"))
    n_short = short.count()
    if n_short:
        best = best.join(full, "query_id", "left_semi").union(found(short, max(1, -(-n_short // block_queries)), True))
    out = best.select("query_id", "looked", F.posexplode("best").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score"), "looked")
