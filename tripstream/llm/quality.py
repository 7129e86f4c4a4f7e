"""Quality classifier: Bradley-Terry scores learned from all preference pairs, cut at a score quantile.

The loss of all pairs of a good and a bad row is a sum over the rows, given how the other class's scores are spread. That
spread is kept in narrow bins with the moments inside each, so that no pair is left out and none is formed. Sums over rows
are of whole multiples of a small unit, and so the same however the rows are dealt.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from math import factorial
from operator import eq

import numpy as np
import pyarrow as pa
from numpy.polynomial import Polynomial
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, forget, give_back, held_out, pick

#: Up to so many training rows are gathered and summed on the driver, more by jobs over a table; the sums are equal.
LOCAL_ROWS = 10_000
#: Rows summed at once; with UNIT, it keeps every partial sum a whole number below 2**53.
BLOCK = 1024
UNIT = 2.0**36
#: So many texts at a time become Python strings.
TEXTS = 256
#: Scores are binned this wide; the pairs' losses are expanded in the places inside the bins up to this order (error 1e-10).
WIDTH = 1 / 16
ORDER = 5
RIDGE = 1e-4
#: The fit ends when no component of the mean gradient over all pairs is larger.
SLOPE = 1e-8
#: A document is predicted good from this score on; the chosen quantile of raw scores is mapped to it.
CUT = 0.3

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\f\v", "\n", "!?", ".,;:'\"", "|", "#$%&*@^~`", "<>{}[]()\\/=+_-"), 1):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 11
N_FEATURES = 20


def features(text: str | None) -> list[float]:
    """Of the whole text; an empty or null text has those of no words."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    c = np.bincount(_CLASS[raw], minlength=12) / max(1, len(raw))
    words = text.split()
    n = len(words)
    some = max(1, n)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1e-9, c[1] + c[2])
    kinds = set(words)
    return [
        np.log1p(n), np.log1p(len(raw) / some), c[1] / letters, c[3], c[5], c[6], c[7], c[8], c[9], c[0] + c[11],
        np.sqrt(c[5]), np.sqrt(c[7]), np.sqrt(c[8]), len(kinds) / some, np.log1p(n) * len(kinds) / some,
        sum(map(eq, words, words[1:])) / some, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(some / max(1, len(lines))),
        float(n < 10), float(c[1] / letters > 0.5),
    ]


class Ranking:
    """score(document) = weights . features; P(a preferred to b) = 1 / (1 + exp(score(b) - score(a)))."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float):
        self.mean, self.scale, self.weights, self.cut = mean, scale, weights, cut

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Summed feature by feature: a row's score has the same bits whatever rows it comes with."""
        out = np.zeros(len(x))
        for k, w in enumerate(self.weights):
            out += np.clip((x[:, k] - self.mean[k]) / self.scale[k], -8, 8) * w
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut + np.log(CUT / (1 - CUT)), -500, 500)))


Sums = dict[int, np.ndarray]
Each = Callable[[np.ndarray, np.ndarray], Sums]


def _add(out: Sums, more: Sums) -> None:
    for k, v in more.items():
        out[k] = out[k] + v if k in out else v.astype(object)


def _largest(out: Sums, more: Sums) -> None:
    for k, v in more.items():
        out[k] = np.maximum(out[k], v) if k in out else v


def _blocks(out: Sums, x: np.ndarray, y: np.ndarray, each: Each, merge: Callable[[Sums, Sums], None]) -> None:
    for at in range(0, len(x), BLOCK):
        merge(out, each(x[at : at + BLOCK], y[at : at + BLOCK]))


def _unpacked(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<f8").reshape(-1, N_FEATURES)
    return x, np.array(b.column("label").to_pylist(), np.int64)


class Rows:
    """Training rows in memory: features, and labels 1 or 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def fold(self, each: Each, merge: Callable[[Sums, Sums], None] = _add) -> Sums:
        out: Sums = {}
        _blocks(out, self.x, self.y, each, merge)
        return out


class Table:
    """Training rows in a table (label, x: the packed features); a fold is a job, and a task sends only what it summed."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def fold(self, each: Each, merge: Callable[[Sums, Sums], None] = _add) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part: Sums = {}
            for b in batches:
                _blocks(part, *_unpacked(b), each, merge)
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(part)]}, pa.schema([("part", pa.binary())]))

        out: Sums = {}
        for r in self.rows.mapInArrow(run, "part binary").collect():
            merge(out, pickle.loads(r.part))
        return out


def _binned(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each score the bin and the place in it, -0.5 to 0.5."""
    k = np.rint(s / WIDTH)
    return k.astype(np.int64), s / WIDTH - k


def _by_bin(k: np.ndarray, y: np.ndarray, columns: list[np.ndarray]) -> Sums:
    """Sums of the columns, in units, by 2 * bin + label."""
    keys, at = np.unique(2 * k + y, return_inverse=True)
    sums = np.stack([np.bincount(at, np.rint(c * UNIT)) for c in columns], 1).astype(np.int64)
    return dict(zip(keys.tolist(), sums))


def _dense(found: Sums) -> tuple[int, np.ndarray, np.ndarray]:
    """The first bin, and of all bins from it to the last one the sums of good and of bad rows."""
    low, high = min(found) // 2, max(found) // 2
    out = np.zeros((2, high - low + 1, len(next(iter(found.values())))))
    for k, v in found.items():
        out[k % 2, k // 2 - low] = (v / UNIT).astype(float)
    return low, out[1], out[0]


def _derivatives(bins: int) -> list[np.ndarray]:
    """log(1 + exp(t)) and its derivatives, at the distances of that many bins from one another, least first."""
    t = np.arange(1 - bins, bins) * WIDTH
    s, p = 1 / (1 + np.exp(-np.clip(t, -700, 700))), Polynomial([0, 1])
    out = [np.logaddexp(0, t), s]
    for _ in range(ORDER):
        p = p.deriv() * Polynomial([0, 1, -1])
        out.append(p(s))
    return out


def _seen_by_good(bad: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each bin g: the sum over the bins b of bad[b] * d(b - g)."""
    return np.correlate(d, bad, "valid")[::-1]


def _seen_by_bad(good: np.ndarray, d: np.ndarray) -> np.ndarray:
    """For each bin b: the sum over the bins g of good[g] * d(b - g)."""
    return np.convolve(d, good, "valid")


class Spread:
    """How the two classes' scores under a model are spread: the mean loss of all pairs, and what each row adds to its slope."""

    def __init__(self, data: Rows | Table, model: Ranking, n: tuple[int, int]):
        self.model, self.n = model, n

        def moments(x: np.ndarray, y: np.ndarray) -> Sums:
            k, u = _binned(model.raw(x))
            powers = [np.ones(len(u))]
            for _ in range(ORDER):
                powers.append(powers[-1] * u)
            return _by_bin(k, y, powers)

        self.low, good, bad = _dense(data.fold(moments))
        units = np.array([WIDTH**p / factorial(p) for p in range(ORDER + 1)])
        self.good, self.bad, self.units = good * units / n[1], bad * units / n[0], units
        self.d = _derivatives(len(good))
        self.loss = RIDGE / 2 * float(model.weights @ model.weights) + sum(
            (-1) ** p * float(self.good[:, p] @ _seen_by_good(self.bad[:, q], self.d[p + q])) for p in range(ORDER + 1) for q in range(ORDER + 1 - p)
        )

    def slope(self, data: Rows | Table) -> tuple[np.ndarray, np.ndarray]:
        """The gradient of the loss, and its Hessian with each score at the middle of its bin."""
        model, low, n, d = self.model, self.low, self.n, self.d
        orders = range(ORDER + 1)
        # by label, power and bin: the chance that a row loses (good) or wins (bad) against one of the other class
        chance = np.stack([
            [sum((-1) ** q * _seen_by_bad(self.good[:, q], d[1 + p + q]) for q in range(ORDER + 1 - p)) * self.units[p] for p in orders],
            [sum((-1) ** p * _seen_by_good(self.bad[:, q], d[1 + p + q]) for q in range(ORDER + 1 - p)) * self.units[p] for p in orders],
        ])
        bend = np.sqrt(np.maximum(0, [_seen_by_bad(self.good[:, 0], d[2]), _seen_by_good(self.bad[:, 0], d[2])]))
        top = 2 * (low + len(self.good))

        def slopes(x: np.ndarray, y: np.ndarray) -> Sums:
            z = np.clip((x - model.mean) / model.scale, -8, 8)
            k, u = _binned(model.raw(x))
            a = np.zeros(len(u))
            for p in reversed(orders):
                a = a * u + chance[y, p, k - low]
            out = _by_bin(k, y, list(z.T))
            for label in (0, 1):
                own = y == label
                # whole numbers of at most 20 bits: their products' sums are exact in any order
                r = np.rint(z[own] * bend[label, k[own] - low][:, None] * 2.0**18)
                out[top + label] = np.rint(z[own] * a[own][:, None] * UNIT).astype(np.int64).sum(0)
                out[top + 2 + label] = np.einsum("ni,nj->ij", r, r).astype(np.int64)
            return out

        found = data.fold(slopes)
        g0, g1, h0, h1 = (found.pop(top + i).astype(float) for i in range(4))
        _, good, bad = _dense(found)
        good, bad = good / n[1], bad / n[0]
        cross = good.T @ np.stack([_seen_by_good(c, d[2]) for c in bad.T], 1)
        g = (g0 / n[0] - g1 / n[1]) / UNIT + RIDGE * model.weights
        return g, (h0 / n[0] + h1 / n[1]) / 2.0**36 - cross - cross.T + RIDGE * np.eye(N_FEATURES)


def _ordered(s: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits in the order of the scores, one for each."""
    b = (s + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))


def _value(o: int) -> float:
    return float(np.uint64(o - (1 << 63) if o >> 63 else ~o & (1 << 64) - 1).view(np.float64))


def _best_cut(data: Rows | Table, model: Ranking, n: tuple[int, int]) -> float:
    """The cut midway between two neighbouring scores at which the classes' hit rates have the greatest sum, the lowest of several.

    Counts by the first bits of the scores tell where it may lie, and only there more bits are looked at, up to all 64.
    """
    active, known = {0: (0, n[1])}, 0
    for bits in (20, 32, 44, 56, 64):
        inside, shift, up = np.array(sorted(active), np.uint64), np.uint64(64 - bits), np.uint64(bits - known)

        def counts(x: np.ndarray, y: np.ndarray) -> Sums:
            o = _ordered(model.raw(x)) >> shift
            here = np.isin(o >> up, inside)
            keys, at = np.unique(o[here], return_inverse=True)
            n1 = np.bincount(at, y[here], minlength=len(keys)).astype(np.int64)
            return dict(zip(keys.tolist(), np.stack([np.bincount(at, minlength=len(keys)) - n1, n1], 1)))

        found, places = data.fold(counts), []
        before: dict[int, tuple[int, int]] = active
        for key in sorted(found):
            bad, good = before[key >> (bits - known)]  # bad rows below, good rows from here on
            here = found[key]
            places.append((key, bad, good, bad * n[1] + good * n[0], int(here[0])))
            before[key >> (bits - known)] = (bad + int(here[0]), good - int(here[1]))
        best = max(p[3] for p in places)
        active, known = {key: (bad, good) for key, bad, good, hits, own in places if hits + own * n[1] >= best}, bits
    at = min(key for key, _, _, hits, _ in places if hits == best)

    def below(x: np.ndarray, y: np.ndarray) -> Sums:
        o = _ordered(model.raw(x))
        return {0: np.array([o[o < np.uint64(at)].max()])} if (o < np.uint64(at)).any() else {}

    left, v = data.fold(below, _largest), _value(at)
    if not left:
        return v - 1
    u = _value(int(left[0][0]))
    return (u + v) / 2 if (u + v) / 2 > u else v


def fit_all(data: Rows | Table) -> Ranking:
    """From rows and their labels, 1 or 0: every pair of a good and a bad row prefers the good one, and all pairs count alike.

    The weights are the minimum of the mean loss of all pairs and a ridge, found by Newton's steps. The cut is the quantile
    of the rows' raw scores, midway between two neighbours, at which the mean of the two classes' hit rates is greatest.
    With one class or no rows there is no pair, and every score is 0.5.
    """

    def totals(x: np.ndarray, y: np.ndarray) -> Sums:
        return {0: np.array([(y == 0).sum(), (y == 1).sum()]), 1: np.rint(x * UNIT).astype(np.int64).sum(0)}

    found = data.fold(totals)
    n = tuple(int(c) for c in found[0]) if found else (0, 0)
    if not all(n):
        return Ranking(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), float(np.log(CUT / (1 - CUT))))
    mean = (found[1] / sum(n)).astype(float) / UNIT
    squares = data.fold(lambda x, y: {0: np.rint((x - mean) ** 2 * UNIT).astype(np.int64).sum(0)})[0]
    scale = np.sqrt((squares / sum(n)).astype(float) / UNIT) + 1e-6
    now = Spread(data, Ranking(mean, scale, np.zeros(N_FEATURES), 0.0), n)
    g, h = now.slope(data)
    while np.abs(g).max() > SLOPE:
        step, size = -np.linalg.solve(h, g), 1.0
        while size > 1e-6:
            then = Spread(data, Ranking(mean, scale, now.model.weights + size * step, 0.0), n)
            if then.loss <= now.loss + 1e-4 * size * float(g @ step) + 1e-10:
                break
            size /= 2
        else:
            break  # no step lowers the loss by more than it is rounded
        least, now = np.abs(g).max(), then
        g, h = now.slope(data)
        if least < 1e-6 and np.abs(g).max() > least / 2:
            break
    model = now.model
    return Ranking(mean, scale, model.weights, _best_cut(data, model, n))


def fit(x: np.ndarray, y: np.ndarray) -> Ranking:
    """fit_all of rows in memory."""
    return fit_all(Rows(x, y))


def _features(texts: pa.Array) -> np.ndarray:
    """A row of features per text; only a few texts at a time become Python strings."""
    out = np.empty((len(texts), N_FEATURES))
    for at in range(0, len(texts), TEXTS):
        for i, t in enumerate(texts.slice(at, TEXTS).to_pylist(), at):
            out[i] = features(t)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [row.astype("<f8").tobytes() for row in _features(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(x, pa.binary())], ["doc_id", "x"])
    give_back()


def learn(docs: DataFrame, labels: DataFrame) -> Ranking:
    """From all labelled documents that aren't held out. Of several labels of an id the largest counts, of several texts each is a row.

    Texts become features before they meet their labels, so that no join moves a text.
    """
    known = pick(labels, doc_id="long", quality="int").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    texts = pick(docs, doc_id="long", text="string").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = cut(texts.mapInArrow(_packed, "doc_id long, x binary").join(known.filter(F.col("label").isin(0, 1)), "doc_id").select("label", "x"))
    try:
        return fit_all(Table(rows) if rows.count() > LOCAL_ROWS else Rows(*_unpacked(rows.toArrow())))
    finally:
        forget(rows)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted, text.

    labels: doc_id, quality (1 good, 0 bad). Null and empty texts are scored as texts without words; a null
    doc_id is never learned from and isn't held out; repeated rows are scored alike. Without labels of both
    kinds every score is 0.5. Scoring is a single pass without a shuffle.
    """
    model = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array(model.score(_features(b.column("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), score, b.column("text")], ["doc_id", "score", "text"])

    scored = pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, text string")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "text")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are predicted good; null and empty texts are scored as texts without words."""
    model = learn(docs, labels)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(_features(text)), pa.float64())

    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    kept = plain.filter(score(F.col(f"c{docs.columns.index('text')}").cast("string")) >= CUT)
    return kept.toDF(*docs.columns)
