"""Quality rules as a short-circuit cascade, in DataFrame expressions only."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, cut, forget, pick

_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents on which costs and selectivities are estimated; they decide the order of the rules, never a verdict.
SAMPLE_ROWS = 400
#: Evaluations of a rule, over the sample again and again, when its cost is taken.
EVALUATIONS = 4_000

#: Each is true for a document that fails it. Columns: text and those of measured().
RULES = {
    "symbols": "n_symbols > 0.5 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "repeated_lines": "n_dup_lines > 0.5 * n_lines and n_dup_lines >= 4",
    "exclamations": "length(text) - length(replace(text, '!', '')) > n_words",
    "capitals": f"length(text) - length(translate(text, '{_UPPER}', '')) > 0.6 * word_chars",
    "digits": "length(text) - length(translate(text, '0123456789', '')) > 0.5 * word_chars",
    "few_letters": "length(regexp_replace(text, '[^\\\\p{L}]+', '')) < 0.4 * word_chars",
}


def _without(text, characters: str):
    return F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text and n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word), n_repeat_words.

    Everything is computed within the row. Windows are compared by 64-bit hashes; the positions of repeated
    windows are sought only in texts that have some.
    """
    d = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim(F.col("text"), F.lit(_BLANKS))
    d = d.withColumn("w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE)))
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)) != ""))
    d = d.withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    at = lambda i, j: F.get(F.col("hashes"), i + j)
    last = F.size("w") - 5
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[at(i, j) for j in range(5)]))
    d = d.withColumn("windows", F.when(last > 0, windows).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    # the number is never negative; not being deterministic, it keeps later filters above, where `sorted` is a column and not worked out anew per element
    d = d.withColumn("sorted", F.when(twice & (F.monotonically_increasing_id() >= 0), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h: bigint, i: int>>")))
    # a repeated window has a neighbour with the same hash
    same = lambda x, j: F.coalesce(F.get(F.col("sorted"), j)["h"] == x["h"], F.lit(False))
    d = d.withColumn("hits", F.transform(F.filter("sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(F.sort_array("hits"), none, lambda a, p: F.struct((a["n"] + p + 5 - F.greatest(p, a["end"])).cast("long").alias("n"), (p + 5).alias("end")))["n"]
    return d.select(
        "doc_id", "text", F.size("w").cast("long").alias("n_words"), _without(F.col("text"), _BLANKS).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        covered.alias("n_repeat_words"),
    )


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About `rows` rows of docs (doc_id, text), by a hash of both: a fraction of every part of the table, whatever its order."""
    d = pick(docs, doc_id="long", text="string")
    every = d.count()
    return d if every <= rows else d.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1_000_000)) < F.lit(max(1, rows * 1_000_000 // every)))


def rule_costs(sample: DataFrame, rules: dict[str, str] = RULES, evaluations: int = EVALUATIONS) -> dict[str, tuple[float, float]]:
    """For each rule the seconds of one evaluation and the share of the sample that fails it.

    The sample is written so often that a rule's job makes about `evaluations` of them; the time of a job with next to
    no rule over the same columns goes off, so that what remains is the rule's own. The first job only warms up.
    """
    rows = sample.count()
    copies = F.explode(F.sequence(F.lit(1), F.lit(max(1, evaluations // max(1, rows)))))
    many = cut(sample.withColumn("copy", copies).drop("copy").repartition(1))
    n = max(1, many.count())

    def seconds(rule: str) -> tuple[float, int]:
        began = time.perf_counter()
        failed = many.filter(F.expr(rule) & (F.length("text") >= -1)).count()
        return time.perf_counter() - began, failed

    seconds("n_words < 0")
    empty = min(seconds("n_words < 0")[0] for _ in range(2))
    out = {}
    for name, rule in rules.items():
        took, failed = min(seconds(rule) for _ in range(2))
        out[name] = (max(took - empty, 1e-6) / n, failed / n)
    forget(many)
    return out


def rule_order(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names by rejections per second of cost on a sample of docs, the most first."""
    sample = cut(measured(sampled(docs, sample_rows)).repartition(1))
    gain = {name: share / cost for name, (cost, share) in rule_costs(sample, rules).items()}
    forget(sample)
    return sorted(rules, key=lambda n: (-gain[n], n))


def quality_cascade(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): the measures, base_failed, kept, failed_rule.

    Base: fewer than 10 words, or more than a fifth of the words in repeated 5-word windows. Other documents pass
    the rules in the order of rule_order(), and no rule runs after the first that fails; any order gives the same
    verdicts. A null or empty text has no words and fails. Repeated rows are judged alike; no rows give no rows. No shuffle.
    """
    order = rule_order(docs, rules, sample_rows)
    m = measured(docs)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    first = F.when(base, "base")
    for name in order:
        first = first.when(F.expr(rules[name]), name)
    return m.withColumn("base_failed", base).withColumn("failed_rule", first).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule"
    )


#: The base columns in SQL; kept as an OR of all rules, since their order has no part in the verdict.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce("text", '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
v AS (SELECT *, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END AS g FROM w),
e AS (SELECT rid, unnest(g) AS g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT *, row_number() OVER () AS rid FROM v)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM e) WHERE c > 1),
k AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM h) GROUP BY rid),
m AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(k.n, 0)::BIGINT AS n_repeat_words
      FROM (SELECT *, row_number() OVER () AS rid FROM v) v LEFT JOIN k USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.5 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR (n_dup_lines > 0.5 * n_lines AND n_dup_lines >= 4)
            OR length(t) - length(replace(t, '!', '')) > n_words OR length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) > 0.6 * word_chars
            OR length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) > 0.5 * word_chars OR length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < 0.4 * word_chars) AS kept
FROM b
"""
