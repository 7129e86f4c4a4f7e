"""N-gram Jaccard join by PartEnum signatures.

Sizes fall into bands so narrow that two linked sets lie in one band or in neighbouring ones. For a band and its
upper neighbour the similarity bounds the number k of differing features. The feature domain is cut into so many
parts that some part has at most a few of the k differences; each part is cut into smaller ones, and there is a
signature for every subset of these that leaves so many out: of two linked sets one subset holds the same
features. Sets that share a signature are candidates; exact sets are compared before anything counts as a link.
Groups of candidates that are too large for one comparison are divided anew by larger subsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, forest, spanned
from .hashing import mix, shingles
from .shared import cut, forget, give_back, parts, pick

#: Sets compared in one block; larger candidate groups are compared by pairs of blocks.
BLOCK = 384
#: From so many parts on, an agreement on empty parts alone is as improbable as a collision of the hashes:
#: some k errors would have to hit nearly k different parts of k + 1, which has about the chance exp(-k).
MANY = 48
#: So often an agreement on an empty part is backed by another division of the domain.
DEPTH = 3
#: Signatures leave out so many of so many smaller parts. Single parts would be less to move, but passages that many
#: texts share then chain ever more of them into one group as the corpus grows.
FIRST = (1, 4)
#: A group of more than BLOCK sets is divided again, in turn by these.
REFINE = ((2, 6), (3, 8))
#: From so many differences on, sets that agree on empty subsets alone are left to chance: at spare 3 that needs more
#: than 3 differences in each of 100 parts but one, about exp(-50).
MOST_BACKED = 400
#: Sets of a large group that every block of it meets.
PIVOTS = 64
#: Up to so many rows of (class, group), a few numbers each, are broadcast; beyond it, the join shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of text whose signatures meet in one task, about 1.2 bytes for each; and so many tasks at least.
RANGE_BYTES = 12_000_000
LEAST_RANGES = 12
#: Signatures that a worker holds before it deals them out.
CHUNK = 500_000
#: Documents whose rows a worker gathers, and among which copies are dealt out once.
NOTES = 10_000


@lru_cache(64)
def bands(num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest size of each band up to most, and k for the pairs in band i or between i and i + 1."""
    tops = [0]
    while tops[-1] < most:
        tops.append((tops[-1] + 1) * den // num)
    tops.append((tops[-1] + 1) * den // num)
    tops = np.array(tops, np.int64)
    upper = np.minimum(np.append(tops[1:], tops[-1] * den // num), tops * den // num)
    return tops, (den - num) * (tops + np.maximum(tops, upper)) // (den + num)


def _parts(h: np.ndarray, n: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts that aren't empty, and the hash of the features in each; h is sorted."""
    if level:
        h = np.sort(mix(h, 1000 + level))
    part = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    first = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    with np.errstate(over="ignore"):
        return h, part[first], np.add.reduceat(mix(h, 5), first)


def _signatures(h: np.ndarray, n: int, path: int, level: int, out: list[np.ndarray]) -> None:
    with np.errstate(over="ignore"):
        own, part, value = _parts(h, n, level)
        out.append(mix(value + mix(part, path), 11 + level))
        if len(part) < n <= MANY:  # agreement on an empty part: the signature is that part's, with one of another division
            gone = np.ones(n, bool)
            gone[part.astype(np.int64)] = False
            for p in np.flatnonzero(gone):
                deeper = int(mix(np.array([path * 131 + int(p) + 1], np.uint64), 7)[0] >> np.uint64(24))
                if level < DEPTH:
                    _signatures(own, n, deeper, level + 1, out)
                else:
                    out.append(np.array([deeper], np.uint64))


@lru_cache(64)
def _subsets(small: int, spare: int) -> np.ndarray:
    """A column for each subset of the small parts without `spare` of them."""
    out = np.ones((small, len(list(combinations(range(small), spare)))), np.uint64)
    for i, gone in enumerate(combinations(range(small), spare)):
        out[list(gone), i] = 0
    return out


def signatures(h: np.ndarray, num: int, den: int, spare: int, small: int) -> np.ndarray:
    """The set's signatures in its band's instance, shared with the next band, and in the one shared with the band below.

    Of k differences some part of (k + 1) / (spare + 1) has `spare` at most, and then one subset of its small parts
    has none. An empty subset is backed by signatures of single parts. h is sorted.
    """
    tops, ks = bands(num, den, 1 << max(8, (len(h) - 1).bit_length()))
    at = int(np.searchsorted(tops, len(h)))
    own = h if spare == FIRST[0] else np.sort(mix(h, 2000 + spare))
    value = mix(own, 6)
    out: list[np.ndarray] = []
    for instance in (at - 1, at):
        if instance <= 0:
            continue
        k = int(ks[instance])
        t = min(spare, k)
        n1, n2 = -(-(k + 1) // (t + 1)), small if t else 1
        part = (((own >> np.uint64(32)) * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
        with np.errstate(over="ignore"):
            sums, filled = np.zeros(n1 * n2, np.uint64), np.zeros(n1 * n2, np.uint64)
            sums[part[first]] = np.add.reduceat(value, first)
            filled[part[first]] = 1
            choice = _subsets(n2, t)
            name = mix(np.arange(n1 * choice.shape[1], dtype=np.uint64), instance * 1_000_003 + spare).reshape(n1, -1)
            some = filled.reshape(n1, n2) @ choice > 0
            out.append(mix(sums.reshape(n1, n2) @ choice + name, 31)[some])
        for path in name[~some] if k < MOST_BACKED else ():
            _signatures(own, k + 1, int(path >> np.uint64(24)), 1, out)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _key(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return tuple(int(x) for x in np.array([mix(h, 21).sum(), mix(h, 22).sum()], np.uint64).view(np.int64))


#: Bytes that are sent of a signature, to which its range among the others adds bits, and of the node that has it.
#: Nodes or signatures that agree by chance only make candidates.
SENT = 5
_MASK = (1 << 8 * SENT) - 1


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()


def _unpacked(raw: Iterable[bytes]) -> np.ndarray:
    some = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, SENT)
    out = np.zeros((len(some), 8), np.uint8)
    out[:, :SENT] = some
    return out.view("<u8").ravel()


_NOTE = "part int, kind int, ids binary, sigs binary"
_NOTE_NAMES = ("part", "kind", "ids", "sigs")


def _dealt(sigs: list[np.ndarray], nodes: list[np.ndarray], ranges: int) -> list[tuple[int, int, bytes, bytes]]:
    """The signatures of some sets by range of value (kind 1), and a spanning forest of the nodes that share some here (kind 2).

    A signature goes on once, for the smallest node of its tree in the forest: a group that fills them is one node from here on.
    """
    rows: list[tuple[int, int, bytes, bytes]] = []
    if not sigs:
        return rows
    s, n = np.concatenate(sigs), np.concatenate(nodes)
    order = np.argsort(s, kind="stable")
    s, n = s[order], n[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    with_next = np.flatnonzero(~new)
    known, roots = forest(n[with_next - 1], n[with_next])
    if len(known):
        pairs = np.column_stack([roots, known])[roots != known]
        spot = (pairs[:, 1] % ranges).astype(np.int64)
        for p in np.unique(spot):
            rows.append((int(p), 2, np.ascontiguousarray(pairs[spot == p]).tobytes(), b""))
    s, n = s[new], n[new]
    if len(known):
        at = np.minimum(np.searchsorted(known, n), len(known) - 1)
        n = np.where(known[at] == n, roots[at], n)
    slot = (((s >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(slot[1:] != slot[:-1]) + 1, [len(s)])) if len(s) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        rows.append((int(slot[lo]), 1, _packed(n[lo:hi]), _packed(s[lo:hi])))
    return rows


class _Dealer:
    """Gathers sets' signatures and deals them out, about CHUNK at a time."""

    def __init__(self, ranges: int):
        self.ranges, self.sigs, self.nodes, self.size = ranges, [], [], 0

    def add(self, node: int, sigs: np.ndarray) -> None:
        self.sigs.append(sigs)
        self.nodes.append(np.full(len(sigs), node & _MASK, np.int64))
        self.size += len(sigs)

    def dealt(self, least: int = 0) -> Iterator[pd.DataFrame]:
        if self.size > least:
            yield pd.DataFrame(_dealt(self.sigs, self.nodes, self.ranges), columns=_NOTE_NAMES)
            self.sigs, self.nodes, self.size = [], [], 0


def _scan(k: int, num: int, den: int, ranges: int):
    """Rows of the documents (kind 0), and their signatures by range of value (kind 1), one node for each; batches may be small."""

    def noted(info: np.ndarray) -> pd.DataFrame:
        where = info[:, 0] % ranges
        return pd.DataFrame([(int(p), 0, np.ascontiguousarray(info[where == p]).tobytes(), b"") for p in np.unique(where)], columns=_NOTE_NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealer, seen, held, size = _Dealer(ranges), set(), [], 0
        for b in batches:
            docs: list[tuple[int, int, int]] = []
            known = b["doc_id"].notna().to_numpy()
            for i, h in enumerate(shingles(b["text"].tolist(), k)):
                one, two = _key(h) if len(h) else (0, 0)
                docs.append((len(h), one, two))
                if len(h) and known[i] and one not in seen:
                    seen.add(one)
                    dealer.add(one, signatures(h, num, den, *FIRST))
                    yield from dealer.dealt(CHUNK)
            ids = b["doc_id"].fillna(0).astype("int64").to_numpy()
            held.append(np.column_stack([ids, known.astype(np.int64), np.array(docs, np.int64).reshape(-1, 3)]))
            size += len(b)
            if size >= NOTES:
                yield noted(np.concatenate(held))
                held, size = [], 0
                seen.clear()
        yield from dealer.dealt()
        if held:
            yield noted(np.concatenate(held))
        give_back()

    return run


def _rescan(k: int, num: int, den: int, ranges: int, spare: int, small: int):
    """Batches (text, k1, k2, comp): signatures of their sets within their groups."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealer = _Dealer(ranges)
        for b in batches:
            for h, one, two, comp in zip(shingles(b["text"].tolist(), k), b["k1"], b["k2"], b["comp"], strict=True):
                if len(h) and _key(h) == (one, two):  # a repeated doc_id brings other texts along
                    dealer.add(one, mix(signatures(h, num, den, spare, small) ^ mix(np.array([comp], np.int64).view(np.uint64), 41)))
                    yield from dealer.dealt(CHUNK)
        yield from dealer.dealt()
        give_back()

    return run


_FOUND = "kind int, a long, b long, n long, k1 long, k2 long"


def _meet(_key, group: pd.DataFrame) -> pd.DataFrame:
    """Documents as they are; of the nodes that share a signature, a spanning forest."""
    out = []
    for ids in group["ids"][group["kind"] == 0]:
        x = np.frombuffer(ids, np.int64).reshape(-1, 5)
        out.append(pd.DataFrame({"kind": 0, "a": x[:, 0], "b": x[:, 1], "n": x[:, 2], "k1": x[:, 3], "k2": x[:, 4]}))
    pairs = [np.frombuffer(ids, np.int64).reshape(-1, 2) for ids in group["ids"][group["kind"] == 2]]
    some = group[group["kind"] == 1]
    if len(some):
        s, n = _unpacked(some["sigs"]), _unpacked(some["ids"]).view(np.int64)
        order = np.argsort(s, kind="stable")
        s, n = s[order], n[order]
        more = np.flatnonzero((s[1:] == s[:-1]) & (n[1:] != n[:-1]))
        pairs.append(np.column_stack([n[more], n[more + 1]]))
    if pairs:
        x = np.concatenate(pairs)
        x = spanned(x[:, 0], x[:, 1])
        out.append(pd.DataFrame({"kind": 1, "a": x[:, 0], "b": x[:, 1], "n": 0, "k1": 0, "k2": 0}))
    return pd.concat(out) if out else pd.DataFrame(columns=["kind", "a", "b", "n", "k1", "k2"])


def link_matrix(sets: list[np.ndarray], num: int, den: int, step: int = 4096) -> np.ndarray:
    """Which sets link: den * intersection >= num * union, exactly, in whole numbers."""
    sizes = np.array([len(s) for s in sets], np.int64)
    every, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = count[at] > 1
    at, owner = at[shared], owner[shared]
    at = np.unique(at, return_inverse=True)[1]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        i, j = np.searchsorted(at, (lo, lo + step))
        x = np.zeros((len(sets), step), np.float32)
        x[owner[i:j], at[i:j] - lo] = 1
        both += x @ x.T  # whole numbers up to 4096: exact
    both = both.astype(np.int64)
    out = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(out, False)
    return out


_LINKS = "a long, b long, links long"


def _compare(k: int, num: int, den: int):
    """Of each group's sets, an edge from each to the smallest node that it reaches here, and its links as far as the task counts them."""

    def run(_task, group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in group.groupby("comp", sort=False):
            sets = list(shingles(g["text"].tolist(), k))
            # a repeated doc_id brings other texts along, or the same again
            own = {key: i for i, key in enumerate(zip(g["k1"], g["k2"], strict=True)) if _key(sets[i]) == key}
            g, sets = g.iloc[list(own.values())], [sets[i] for i in own.values()]
            nodes, weight, block = g["k1"].to_numpy(), g["w"].to_numpy(), g["block"].to_numpy()
            links = link_matrix(sets, num, den)
            counted = links if g["same"].iloc[0] else links & (block[:, None] != block[None, :])
            total = (counted * weight[None, :]).sum(1)
            known, roots = forest(*(nodes[x] for x in np.nonzero(links)))
            root = nodes.copy()
            root[np.isin(nodes, known)] = roots[np.searchsorted(known, nodes[np.isin(nodes, known)])]
            out.append(pd.DataFrame({"a": nodes, "b": root, "links": total}))
        return pd.concat(out)

    return run


_TASK = ("task", "comp", "rep", "w", "block", "k1", "k2", "same")


def _bundled(members: DataFrame) -> DataFrame:
    """Tasks of whole groups that fit one comparison, about 128 sets or one group each."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("m")).filter(F.col("m").between(2, BLOCK))
    bundles = max(1, members.count() // 128)
    task = F.pmod(F.xxhash64("comp"), F.lit(bundles))
    return members.join(sizes, "comp").select(task.alias("task"), "comp", "rep", "w", F.lit(0).alias("block"), "k1", "k2", F.lit(True).alias("same"))


def _blocks_of(members: DataFrame, per_block: int = 0) -> DataFrame:
    """Members of the groups that are too large for one comparison, with the number of blocks and their own."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK)
    blocks = F.ceil(F.col("m") / (per_block or BLOCK)).cast("int")
    return members.join(sizes, "comp").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))


def _pairs_of_blocks(members: DataFrame) -> DataFrame:
    """Tasks in which every block of a large group meets every other once, so that all links are counted."""
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    own = _blocks_of(members).withColumn("pair", F.explode(pair))
    return own.withColumn("task", F.xxhash64("comp", "pair.i", "pair.j")).withColumn("same", F.col("pair.i") == F.col("pair.j")).select(*_TASK)


def _with_pivots(members: DataFrame) -> DataFrame:
    """Tasks of a block of a large group and the group's pivots, about PIVOTS sets that every block meets."""
    own = _blocks_of(members, BLOCK - PIVOTS)
    pivot = F.pmod(F.xxhash64("rep", F.lit(1)), F.ceil(F.col("m") / PIVOTS)) == 0
    own = own.withColumn("to", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    return own.withColumn("task", F.xxhash64("comp", "to")).withColumn("same", F.lit(True)).select(*_TASK)


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """Tasks in which the sets of a large group that are not linked to most of it meet the whole group."""
    joined = connected_components(links.filter("a != b").select("a", "b"))
    own = cut(_blocks_of(members).drop("block", "blocks").join(joined.withColumnsRenamed({"node": "k1", "root": "tree"}), "k1", "left").withColumn("tree", F.coalesce("tree", "k1")))
    forget(joined)
    sizes = own.groupBy("comp", "tree").agg(F.count("*").alias("n"))
    most = sizes.groupBy("comp").agg(F.max(F.struct("n", "tree")).alias("most"), (F.sum("n") - F.max("n")).alias("others"))
    own = own.join(most.filter("others > 0"), "comp").withColumn("most", F.col("most.tree"))
    rows, columns = F.ceil(F.col("others") / (BLOCK // 2)).cast("int"), F.ceil(F.col("m") / (BLOCK // 2)).cast("int")
    own = own.withColumn("i", F.pmod(F.xxhash64("rep"), rows).cast("int")).withColumn("j", F.pmod(F.xxhash64("rep"), columns).cast("int"))
    left = own.filter("tree != most").withColumn("j", F.explode(F.sequence(F.lit(0), columns - 1)))
    right = own.withColumn("i", F.explode(F.sequence(F.lit(0), rows - 1)))
    both = left.select(own.columns).union(right.select(own.columns)).dropDuplicates(["comp", "k1", "k2", "i", "j"])
    return both.withColumn("task", F.xxhash64("comp", "i", "j")).withColumn("same", F.lit(True)).withColumn("block", F.lit(0)).select(*_TASK)


def jaccard_join(docs: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, count_links: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, and n_links if these are counted.

    Two documents link when the Jaccard similarity of their sets of lower-cased word shingles is num/den or more.
    component_id is the smallest doc_id reachable by links, itself included; n_links counts the documents linked.
    A null or wordless text has no shingles and no link. A row without doc_id keeps its size, has no component
    and takes no part. Rows that repeat a doc_id count as documents of their own with that id. Copies are
    compared once, as one class, however many there are.

    Counting needs every pair of different texts in a group of candidates. Without it, a group of more than BLOCK
    texts meets its pivots in blocks, and only what is not linked to most of it then meets the whole group.
    """
    spark = docs.sparkSession
    src = pick(docs, doc_id="long", text="string")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(min(parts(spark), LEAST_RANGES), -(-size // RANGE_BYTES))
    blobs = src.mapInPandas(_scan(shingle, num, den, ranges), _NOTE)
    found = cut(blobs.groupBy("part").applyInPandas(_meet, _FOUND))
    every = found.filter("kind = 0").select(F.when(F.col("b") == 1, F.col("a")).alias("doc_id"), "n", "k1", "k2")
    classes = cut(every.filter("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("w")))
    named = classes.withColumn("node", F.col("k1").bitwiseAND(F.lit(_MASK)))
    coarse = connected_components(found.filter("kind = 1").select("a", "b"))
    members = cut(named.join(coarse.withColumnRenamed("root", "comp"), "node"))
    forget(coarse)
    for spare, small in REFINE:
        large = members.groupBy("comp").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("comp")
        inside = cut(members.join(large, "comp", "left_semi"))
        rows = inside.count()
        if not rows:
            break
        side = inside.select("rep", "k1", "k2", "comp")
        again = src.filter("doc_id is not null").join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, F.col("doc_id") == F.col("rep"))
        blobs = again.select("text", "k1", "k2", "comp").mapInPandas(_rescan(shingle, num, den, ranges, spare, small), _NOTE)
        met = cut(blobs.groupBy("part").applyInPandas(_meet, _FOUND))
        finer = connected_components(met.select("a", "b"))
        divided = inside.drop("comp").join(finer.withColumnRenamed("root", "comp"), "node").select(members.columns)
        before, members = members, cut(members.join(large, "comp", "left_anti").select(members.columns).union(divided))
        forget(before, inside, met, finer)
    known_texts = src.filter("doc_id is not null").select(F.col("doc_id").alias("rep"), "text")

    def compared(tasks: DataFrame) -> DataFrame:
        tasks = cut(tasks)
        side = F.broadcast(tasks) if tasks.count() <= BROADCAST_ROWS else tasks
        links = cut(known_texts.join(side, "rep").groupBy("task").applyInPandas(_compare(shingle, num, den), _LINKS))
        forget(tasks)
        return links

    if count_links:
        links = compared(_bundled(members).union(_pairs_of_blocks(members)))
    else:
        links = compared(_bundled(members).union(_with_pivots(members)))
        if not _blocks_of(members).isEmpty():
            links = links.union(compared(_apart(members, links)))
    final = connected_components(links.filter("a != b").select("a", "b"))
    linked = classes.join(final.withColumnRenamed("node", "k1"), "k1", "left")
    least = linked.filter("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    result = linked.join(least, "root", "left").filter("w > 1 or root is not null").select("k1", "k2", "n", F.coalesce("least", "rep").alias("root"), "w")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")
    if not count_links:
        return every.join(result, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), component)
    counts = links.groupBy(F.col("a").alias("k1")).agg(F.sum("links").alias("links"))
    result = result.join(counts, "k1", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("w") - 1)
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links")
    return every.join(result, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), component, n_links)
