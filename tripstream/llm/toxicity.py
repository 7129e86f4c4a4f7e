"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held_out, labelled_sample, pick

#: At most so many labelled ids are learned from; the order of a hash of the id chooses them.
SAMPLE_IDS = 12_000
BUCKETS = 1 << 18
#: A bucket is learned if so many rows have it.
LEAST = 5
FACTORS = 4
#: A bucket gets weights if its share of toxic rows is so many standard errors off, by what it would be without any
#: relation: a test of evidence, not a number of buckets, so that long texts don't drift by what is noise.
LEAST_Z = 3.5
#: Steps of the fit, rows in each, its step size, and how weights and factors are drawn to zero.
STEPS = 400
ROWS = 2048
RATE = 0.05
DRAW = (2e-4, 1e-3)
#: Words whose buckets a worker remembers.
MEMO = 300_000
#: A toxic row weighs so many clean ones; toxic rows are the rarer.
WEIGHT = 3.0
CUT = 0.5
_TRIM = ".,!?;:\"'()[]{}<>*#$%&|-_"


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of the whole text's words and of their first four and five letters."""
    found = {x for w in set((text or "").lower().split()) for x in word_terms(w)}
    return np.array(sorted(found), np.uint32)


def word_terms(word: str) -> list[int]:
    """Buckets of one white-space-free piece of lower-cased text."""
    w = word.strip(_TRIM)
    names = [w] * bool(w) + [f"{w[:5]}~"] * (len(w) > 5) + [f"{w[:4]}~"] * (len(w) > 4)
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


class Machine:
    """w0 + sum of w_i + sum over pairs of v_i . v_j, over the buckets that a text has."""

    def __init__(self, buckets: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v
        self.place = {int(b): i for i, b in enumerate(buckets)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        """Of the whole text. Pieces met before are remembered, up to MEMO of them."""
        known: set[int] = set()
        for w in set((text or "").lower().split()):
            at = self.memo.get(w)
            if at is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                at = self.memo[w] = tuple(self.place[x] for x in word_terms(w) if x in self.place)
            known.update(at)
        at = sorted(known)
        v = self.v[at]
        raw = self.w0 + self.w[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -500, 500))))


def fit(found: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Machine:
    """With one class only or no rows, every score is that class's (0 without rows)."""
    n, share = len(y), float(np.mean(y)) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Machine(np.empty(0, np.uint32), 8.0 if share else -8.0, np.empty(0), np.empty((0, FACTORS)))
    df = np.bincount(np.concatenate(found), minlength=BUCKETS)
    pos = np.bincount(np.concatenate([f for f, t in zip(found, y, strict=True) if t]), minlength=BUCKETS)
    with np.errstate(all="ignore"):
        z = np.abs(pos - df * share) / np.sqrt(df * share * (1 - share) * (1 - df / n + 1e-9))
    known = np.flatnonzero((df >= LEAST) & (z >= LEAST_Z)).astype(np.uint32)
    place = np.full(BUCKETS, -1, np.int64)
    place[known] = np.arange(len(known))
    cols = [place[f] for f in found]
    cols = [c[c >= 0] for c in cols]
    sizes = np.array([len(c) for c in cols])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate([*cols, np.empty(0, np.int64)])
    rng = np.random.default_rng(seed)
    # columns: the weight, then the factors
    theta = np.zeros((len(known), 1 + FACTORS))
    theta[:, 1:] = rng.normal(0, 0.05, (len(known), FACTORS))
    first, second, w0, m0, s0 = np.zeros_like(theta), np.zeros_like(theta), float(np.log(share / (1 - share))), 0.0, 0.0
    y = np.asarray(y, float)
    for step in range(1, STEPS + 1):
        rate = RATE * (1 - (step - 1) / STEPS)
        rows = rng.choice(n, min(n, ROWS), replace=False)
        rows = rows[sizes[rows] > 0]
        if not len(rows):
            continue
        count = sizes[rows]
        at = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(rows)), count)
        terms_ = flat[np.repeat(starts[rows], count) + np.arange(count.sum()) - at[owner]]
        own = theta[terms_]
        sums = np.add.reduceat(own, at)
        raw = w0 + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - np.add.reduceat((own[:, 1:] ** 2).sum(1), at))
        e = (1 / (1 + np.exp(-np.clip(raw, -50, 50))) - y[rows]) * np.where(y[rows] > 0, WEIGHT, 1.0) / len(rows)
        each = e[owner]
        grad = np.empty_like(theta)
        grad[:, 0] = np.bincount(terms_, each, len(known))
        for f in range(1, 1 + FACTORS):
            grad[:, f] = np.bincount(terms_, each * (sums[owner, f] - own[:, f]), len(known))
        grad += np.array([DRAW[0]] + [DRAW[1]] * FACTORS) * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        m0, s0 = 0.9 * m0 + 0.1 * e.sum(), 0.99 * s0 + 0.01 * e.sum() ** 2
        w0 -= rate * (m0 / (1 - 0.9**step)) / (np.sqrt(s0 / (1 - 0.99**step)) + 3e-4)
    return Machine(known, float(w0), theta[:, 0], theta[:, 1:])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"label": b["label"], "x": [terms(t).tobytes() for t in b["text"]]})


def learn(docs: DataFrame, labels: DataFrame, sample_ids: int = SAMPLE_IDS) -> Machine:
    """From the labelled documents that aren't held out, sample_ids ids at most; only their buckets reach the driver."""
    rows = labelled_sample(pick(docs, doc_id="long", text="string"), labels, "toxic", sample_ids)
    got = rows.select("label", "text").mapInPandas(_rows, "label int, x binary").collect()
    got.sort(key=lambda r: (bytes(r.x), r.label))
    return fit([np.frombuffer(r.x, np.uint32) for r in got], np.array([r.label for r in got], np.int64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_ids: int = SAMPLE_IDS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    labels: doc_id, toxic (1 or 0). Null and empty texts have no terms and get the bias alone; a null doc_id is
    never learned from and isn't held out; repeated rows are scored alike. Scoring is one pass without a shuffle.
    """
    model = learn(docs, labels, sample_ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [model.score(t) for t in b["text"]]})

    scored = pick(docs, doc_id="long", text="string").mapInPandas(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
