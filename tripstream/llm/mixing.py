"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

A source's target is a number of words. Whole copies of all its documents are certain; the rest of the target is a
sample without replacement whose inclusion probabilities are proportional to size. Documents whose probability would
reach one are certain too. The others rank by random odds over inclusion odds, and the first of that order are taken
until their words make up the sample's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, cut, pick

WEIGHTS = (5, 2, 1)
#: No source, and so no document, is taken more often than this.
REPEATS = 3
#: The rank is cut in so many cells, summed per source before anything is ordered; a cell is taken whole or not at all.
CELLS = 1 << 14
#: Sizes above a half, a quarter ... of the words to sample are ranked apart, the largest first, so that what a large
#: document leaves open goes to smaller ones; in the last stratum is all that is small beside the sample.
STRATA = 5

_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def words_of(text) -> F.Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def uniform(doc_id, text) -> F.Column:
    """A number in (0, 1) from 52 bits of a hash of the id, or of the text where the id is null: the same in every run."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("?"), text), F.lit(""))
    digits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Targets share the sum of all sizes by weight and stop at `repeats` times the source's size; what is over goes
    to the others by weight, until none is above. In the order of size per weight the stopped sources come first,
    so that this needs no iteration. Its windows without a key are over a row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", repeats * F.col("source_size"))
    by = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(rest))
    per = per.withColumn("nth", F.row_number().over(by))
    first = F.min(F.when(F.col("most") > F.col("level") * F.col("weight"), F.struct("nth", "level"))).over(every)
    level = first["level"]  # of the first source that isn't stopped
    per = per.withColumn("at", F.coalesce(level, F.lit(float("inf"))))
    return per.select("source", "source_size", F.least(F.col("at") * F.col("weight"), F.col("most").cast("double")).alias("target"))


def _of_source(df: DataFrame, per_source: DataFrame) -> DataFrame:
    """df with its source's row (s, ...); null is a source. A table of few sources is small enough that Spark broadcasts it."""
    return df.join(per_source, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _whole(x) -> F.Column:
    return F.col(x).cast("decimal(12,0)")


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(s, source_size, target, certain, rest, above, gap, squares) per source, from rows (source, size).

    certain: copies of every document. rest: words to sample. A document larger than rest isn't sampled; one larger
    than `above` (and up to rest) is included for certain; another's probability is gap * size / squares, where gap
    is what the certain ones leave of rest, and squares the sum of the squared sizes from `above` down. Worked out
    over distinct sizes, from the largest down: the first at which the probability falls below one.
    """
    certain = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(REPEATS))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("certain", certain).withColumn("rest", F.floor(F.col("target") - F.col("certain") * F.col("source_size")).cast("long"))
    targets = targets.withColumnRenamed("source", "s")
    each = sizes.groupBy("source", "size").agg(F.sum("size").alias("words"), F.sum(_whole("size") * _whole("size")).alias("squares"))
    each = _of_source(each, targets).filter("size > 0 and size <= rest")
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("gap", F.col("rest") - larger).withColumn("squares", F.sum("squares").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    first = each.filter((F.col("gap") > 0) & (_whole("gap") * _whole("size") < F.col("squares"))).groupBy("source").agg(F.max(F.struct("size", "gap", "squares")).alias("f"))
    first = first.select(F.col("source").alias("of"), F.col("f.size").alias("above"), F.col("f.gap").alias("gap"), F.col("f.squares").alias("squares"))
    both = targets.join(first, F.col("s").eqNullSafe(F.col("of")), "left").drop("of")
    return both.withColumn("above", F.coalesce("above", F.lit(0).cast("long")))


def _ranked(df: DataFrame) -> DataFrame:
    """df (size, u and a source's row) with stratum and cell of the documents that are left to chance, else null.

    With p = gap * size / squares the order of (u / (1 - u)) / (p / (1 - p)) is that of u * (1 - p) / (u * (1 - p) + (1 - u) * p).
    """
    taken = (_whole("gap") * _whole("size")).cast("double")
    left = (F.col("squares") - _whole("gap") * _whole("size")).cast("double")
    rank = F.col("u") * left / (F.col("u") * left + (F.lit(1.0) - F.col("u")) * taken)
    chance = (F.col("size") > 0) & (F.col("size") <= F.col("above"))
    stratum = sum(((F.col("size") * F.lit(1 << k)) <= F.col("rest")).cast("int") for k in range(1, STRATA))
    return df.withColumn("stratum", F.when(chance, stratum)).withColumn("cell", F.when(chance, F.floor(rank * CELLS).cast("int")))


def _cuts(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, cuts): for each stratum the last cell that is taken, or -1.

    A stratum's budget is what its documents are expected to bring, and what the strata before it left open.
    """
    cells = _ranked(_of_source(sizes, plan)).filter("cell is not null")
    cells = cells.groupBy("source", "stratum", "cell", "gap", "squares").agg(F.sum("size").alias("words"), F.sum(_whole("size") * _whole("size")).alias("own"))
    # at most STRATA * CELLS rows of a source, whatever it holds
    per = cells.groupBy("source", "gap", "squares").agg(F.sort_array(F.collect_list(F.struct("stratum", "cell", "words", "own"))).alias("cells"))
    strata = F.sequence(F.lit(0), F.lit(STRATA - 1))
    zero = F.lit(0).cast("decimal(38,0)")
    upto = F.transform(strata, lambda h: F.aggregate("cells", zero, lambda a, x: (a + F.when(x["stratum"] <= h, x["own"]).otherwise(zero)).cast("decimal(38,0)")))
    per = per.withColumn("budget", F.transform(upto, lambda q: F.floor(F.col("gap").cast("double") * q.cast("double") / F.col("squares").cast("double")).cast("long")))
    none = F.struct(F.lit(0).cast("long").alias("taken"), F.lit(-1).alias("closed"), F.transform(strata, lambda h: F.lit(-1)).alias("cuts"))

    def step(a, x):
        fits = (x["stratum"] != a["closed"]) & (a["taken"] + x["words"] <= F.get(F.col("budget"), x["stratum"]))
        return F.struct(
            F.when(fits, a["taken"] + x["words"]).otherwise(a["taken"]).alias("taken"), F.when(fits, a["closed"]).otherwise(x["stratum"]).alias("closed"),
            F.when(fits, F.transform(a["cuts"], lambda c, h: F.when(h == x["stratum"], x["cell"]).otherwise(c))).otherwise(a["cuts"]).alias("cuts"),
        )

    return per.select(F.col("source").alias("of"), F.aggregate("cells", none, step)["cuts"].alias("cuts"))


def _with_copies(df: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """df (source, size, u, ...) with its source's row and `copies`: no shuffle of df itself."""
    sizes = cut(df.select("source", "size", "u"))
    plan = cut(inclusion(sizes, source_targets(sizes, weights, repeats)))
    plan = cut(plan.join(_cuts(sizes, plan), F.col("s").eqNullSafe(F.col("of")), "left").drop("of"))
    both = _ranked(_of_source(df, plan))
    sure = (F.col("size") > F.col("above")) & (F.col("size") <= F.col("rest"))
    drawn = F.coalesce(F.col("cell") <= F.get("cuts", F.col("stratum")), F.lit(False))
    return both.withColumn("copies", F.col("certain") + (sure | drawn).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, size, source_size, target, copies, taken.

    size counts words (null text: 0). Every document is taken floor(target / source_size) times for certain; the
    rest of a source's target is a Pareto sample with probabilities proportional to size (see inclusion()), of as
    many words as are left. So a source's taken words never exceed its target, and a document's never exceed
    `repeats` times its size. An empty source, or none at all, takes nothing; a null source is one. Rows that
    repeat an id have one random number, and so have rows without id that repeat a text.
    """
    d = pick(docs, doc_id="long", text="string", source="string")
    sizes = cut(d.select("doc_id", "source", words_of(F.col("text")).alias("size"), uniform(F.col("doc_id"), F.col("text")).alias("u")))
    return _with_copies(sizes, weights, repeats).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc_id, text, source = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text", "source"))
    text, doc_id = text.cast("string"), doc_id.cast("long")
    plain = docs.toDF(*names).withColumns({"source": source.cast("string"), "size": words_of(text), "u": uniform(doc_id, text)})
    rows = _with_copies(plain, weights, repeats).filter("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*names).toDF(*docs.columns)


def _strata_sql() -> str:
    """The strata one after the other; each takes the cells whose running sum stays within what is open."""
    out = ["t0 AS (SELECT source, 0::HUGEINT AS taken FROM c GROUP BY source)"]
    for h in range(STRATA):
        out.append(
            f"k{h} AS (SELECT t.source, {h} AS stratum, max(cell) AS last, max(run) AS got FROM t{h} t JOIN runs r ON r.source IS NOT DISTINCT FROM t.source "
            f"WHERE r.stratum = {h} AND run <= budget - taken GROUP BY t.source), "
            f"t{h + 1} AS (SELECT t.source, taken + coalesce(got, 0) AS taken FROM t{h} t LEFT JOIN k{h} k ON k.source IS NOT DISTINCT FROM t.source)"
        )
    out.append("k AS (" + " UNION ALL ".join(f"SELECT * FROM k{h}" for h in range(STRATA)) + ")")
    return ",\n".join(out)


_STRATUM = " + ".join(f"(size * {1 << k} <= rest)::INT" for k in range(1, STRATA))
SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
      (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '?' || "text", '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
wt AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS most FROM per),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
      row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS nth FROM wt),
tg AS (SELECT source, source_size, least(coalesce((SELECT level FROM lv WHERE most > level * weight ORDER BY nth LIMIT 1), 'infinity'::DOUBLE) * weight, most::DOUBLE) AS target FROM lv),
tc AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), {REPEATS}) ELSE 0 END::BIGINT AS certain FROM tg),
t AS MATERIALIZED (SELECT *, floor(target - certain * source_size)::BIGINT AS rest FROM tc),
e AS (SELECT d.source, size, rest, sum(size) AS words, sum(size::HUGEINT * size) AS squares FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
      WHERE size > 0 AND size <= rest GROUP BY d.source, size, rest),
f AS (SELECT source, size, rest - coalesce(sum(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap,
      sum(squares) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS squares FROM e),
p AS MATERIALIZED (SELECT source, max(size) AS above, arg_max(gap, size) AS gap, arg_max(squares, size) AS squares FROM f WHERE gap > 0 AND gap * size < squares GROUP BY source),
r AS MATERIALIZED (SELECT d.*, t.source_size, t.target, t.certain, t.rest, coalesce(p.above, 0) AS above, p.gap, p.squares,
      CASE WHEN size > 0 AND size <= p.above THEN {_STRATUM} END AS stratum,
      CASE WHEN size > 0 AND size <= p.above THEN floor(u * (squares - gap * size)::DOUBLE
           / (u * (squares - gap * size)::DOUBLE + (1.0::DOUBLE - u) * (gap * size)::DOUBLE) * {CELLS})::INT END AS cell
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN p ON p.source IS NOT DISTINCT FROM d.source),
c AS (SELECT source, stratum, cell, gap, squares, sum(size) AS words, sum(size::HUGEINT * size) AS own FROM r WHERE cell IS NOT NULL GROUP BY ALL),
runs AS MATERIALIZED (SELECT source, stratum, cell, sum(words) OVER (PARTITION BY source, stratum ORDER BY cell) AS run,
      floor(gap::DOUBLE * (sum(own) OVER (PARTITION BY source ORDER BY stratum RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE / squares::DOUBLE)::HUGEINT AS budget FROM c),
{_strata_sql()}
SELECT doc_id, size, source_size, target, (certain + (coalesce(size > above AND size <= rest, false) OR coalesce(cell <= k.last, false))::BIGINT) * size AS taken
FROM r LEFT JOIN k ON k.source IS NOT DISTINCT FROM r.source AND k.stratum = r.stratum
"""
