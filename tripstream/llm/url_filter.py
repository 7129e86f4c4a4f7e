"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

Features, rules and trees are DataFrame expressions; only the trees' fit, on a bounded sample, runs on the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_text import host_of
from .shared import pick

#: At most so many labelled rows are learned from; the order of a hash of the url chooses them.
SAMPLE_ROWS = 5000
ROUNDS = 24
DEPTH = 3
RATE = 0.3
#: Cuts tried for each feature, at quantiles; rows that a leaf must have.
CUTS = 16
LEAST = 5
RIDGE = 1.0
#: A suffix's share of blocked urls is drawn to the overall share as if by so many urls more.
PRIOR = 20.0
#: Suffix statistics of a row are those of the other folds.
FOLDS = 5

FEATURES = ("length", "host_length", "path_depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "secure", "suffix_share", "suffix_known")


def path_of(url) -> F.Column:
    """After the host, up to ? or # or the end; empty for a null url or one without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host, path, rules: dict[str, str]) -> tuple[F.Column, F.Column]:
    """The longest rule, like example.net/en/, that fits host and path, and what it says; both null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's. Rules of the same length are
    taken in code point order.
    """
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, rules[rule]) if verdict is None else verdict.when(fits, rules[rule])
    return (name, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _entropy(text) -> F.Column:
    """Bits per character."""
    n = F.length(text)
    terms = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(terms, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def suffix_of(host) -> F.Column:
    """The last two labels of the host."""
    return F.substring_index(host, ".", -2)


def with_features(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the lexical features, but for those of suffixes."""
    u = F.coalesce("url", F.lit(""))
    n = F.length(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.select(
        "*", n.cast("double").alias("length"), F.length("host").cast("double").alias("host_length"),
        (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double").alias("path_depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.when(n > 0, (n - F.length(F.translate(u, "0123456789", ""))) / n).otherwise(0.0).alias("digit_ratio"), _entropy(u).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("parameters"),
        (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double").alias("hyphens"),
        u.startswith("https://").cast("double").alias("secure"), suffix_of(F.col("host")).alias("suffix"),
    )


class Boosted:
    """A sum of regression trees for the log-odds of `block`; trees are nested (feature, cut, left, right) or values."""

    def __init__(self, start: float, trees: list):
        self.start, self.trees = start, trees

    def raw(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        def of(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[names.index(tree[0])] <= tree[1] else tree[3]
            return tree

        return np.array([self.start + sum(of(t, row) for t in self.trees) for row in x])

    def column(self) -> F.Column:
        def of(tree):
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            name, cut, low, high = tree
            return F.when(F.col(name) <= cut, of(low)).otherwise(of(high))

        out = F.lit(float(self.start))
        for tree in self.trees:
            out = out + of(tree)
        return out


def boost(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Boosted:
    """Second-order boosting of the logistic loss. With one class only or no rows, the start decides alone (none: allow)."""
    share = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.01
    start = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Boosted(start, [])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])) for j in range(x.shape[1])]
    raw, trees = np.full(len(y), start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = lambda r: -g[r].sum() / (h[r].sum() + RIDGE)
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + RIDGE)
        best = (1e-9, None)
        if depth and len(rows) >= 2 * LEAST:
            for j, some in enumerate(cuts):
                for c in some:
                    low = x[rows, j] <= c
                    if LEAST <= low.sum() <= len(rows) - LEAST:
                        won = gain(rows[low]) + gain(rows[~low]) - gain(rows)
                        if won > best[0] + 1e-12:
                            best = (won, (j, float(c), rows[low], rows[~low]))
        if best[1] is None:
            step = RATE * value(rows)
            raw[rows] += step
            return float(step)
        j, c, low, high = best[1]
        return (names[j], c, grow(low, g, h, depth - 1), grow(high, g, h, depth - 1))

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-raw))
        trees.append(grow(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-6), DEPTH))
    return Boosted(start, trees)


def _examples(labelled: DataFrame, sample_rows: int) -> list:
    """Label, host and features of sample_rows distinct labelled rows at most."""
    rows = pick(labelled, url="string", label="int").filter("label is not null").distinct().orderBy(F.xxhash64("url"), "url", "label").limit(sample_rows)
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    got = with_features(rows).select("label", "host", "suffix", *FEATURES[:-2]).collect()
    return sorted(got, key=lambda r: tuple(r))


def _shares(rows: list, share: float) -> dict[str, float]:
    """Each suffix's share of blocked rows, drawn to the overall share."""
    seen: dict[str, list[float]] = {}
    for r in rows:
        n = seen.setdefault(r.suffix, [0.0, 0.0])
        n[0] += 1
        n[1] += r.label
    return {s: (b + PRIOR * share) / (n + PRIOR) for s, (n, b) in seen.items()}


def _fold(host: str) -> int:
    """Urls of a host are in one fold, so that no row's suffix statistics come from its own host."""
    return zlib.crc32(host.encode("utf-8", "surrogatepass")) % FOLDS


def _matrix(rows: list, shares: list[dict[str, float]], share: float) -> np.ndarray:
    return np.array([[*(r[f] for f in FEATURES[:-2]), own.get(r.suffix, share), float(r.suffix in own)] for r, own in zip(rows, shares, strict=True)], float).reshape(-1, len(FEATURES))


def _fit(rows: list) -> tuple[Boosted, dict[str, float], float]:
    y = np.array([r.label for r in rows], float)
    share = float(y.mean()) if len(y) else 0.0
    others = [_shares([r for r in rows if _fold(r.host) != k], share) for k in range(FOLDS)]
    x = _matrix(rows, [others[_fold(r.host)] for r in rows], share)
    return boost(x, y, FEATURES), _shares(rows, share), share


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Boosted, dict[str, float], float]:
    """The trees, each suffix's smoothed share of blocked urls, and the overall share, from rows (url, label: 1 block, 0 allow).

    sample_rows distinct rows at most are learned from, and so suffixes are fewer. The trees see each row's suffix
    statistics as the other folds' hosts have them.
    """
    return _fit(_examples(labelled, sample_rows))


def held_out_auc(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> float:
    """How often a blocked url of the hosts in fold 0 scores above an allowed one (ties: half), learned from the other hosts; nan without both."""
    rows = _examples(labelled, sample_rows)
    model, suffixes, share = _fit([r for r in rows if _fold(r.host)])
    rest = [r for r in rows if not _fold(r.host)]
    raw, y = model.raw(_matrix(rest, [suffixes] * len(rest), share), FEATURES), np.array([r.label for r in rest])
    good, bad = raw[y == 0], raw[y == 1]
    if not len(good) or not len(bad):
        return float("nan")
    return float(((bad[:, None] > good[None, :]) + 0.5 * (bad[:, None] == good[None, :])).mean())


def url_filter(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, risk (chance to be blocked).

    rules: 'allow' or 'block' by host/path; the longest that fits decides. Other urls go to trees learned from
    labelled (url, label); without it from rule_labels(). A null url, or one without ://, has an empty host and
    path; it is left to the trees. Repeated rows are judged alike; no rows give no rows. No shuffle of pages:
    suffixes, sample_rows at most, are broadcast.
    """
    src = pick(pages, page_id="long", url="string").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    src = src.withColumn("rule", rule).withColumn("said", said)
    model, suffixes, share = learn(rule_labels(pages, rules) if labelled is None else labelled, sample_rows)
    known = pages.sparkSession.createDataFrame(sorted(suffixes.items()), "known_suffix string, known_share double")
    scored = with_features(src).join(F.broadcast(known), F.col("suffix") == F.col("known_suffix"), "left")
    scored = scored.withColumn("suffix_share", F.coalesce("known_share", F.lit(share))).withColumn("suffix_known", F.col("known_share").isNotNull().cast("double"))
    scored = scored.withColumn("raw", model.column())
    verdict = F.coalesce("said", F.when(F.col("raw") > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (1 / (1 + F.exp(-F.col("raw")))).alias("risk"))


def rule_labels(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(url, label) of all pages' urls: 1 for those that a rule blocks, 0 for those that a rule allows or none names.

    So the trees find what else looks like the blocked ones, by lexical features alone, and need evidence to block.
    """
    urls = pick(pages, url="string").filter("url is not null").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return urls.select("url", F.coalesce((matched_rule(F.col("host"), F.col("path"), rules)[1] == "block").cast("int"), F.lit(0)).alias("label"))
