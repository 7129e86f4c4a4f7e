"""The corpus queries: each applies its operator to its whole table; SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, html_text, jaccard_join, mixing, packing, quality, quality_rules, secrets, toxicity, url_filter
from .shared import table
from .stages import tokenizer_path

#: The contract's rules.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

def op1_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op4_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op6_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op7_boosted_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are the rules' verdicts; a url that no rule blocks counts as allowed."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES).drop("risk")


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op10_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_cascade(table(spark, sf_dir, "documents")).drop("failed_rule")


#: Pairs by common shingles; the components by reachability.
SQL6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM g),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
      HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x), k AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT g.doc_id, len(s)::BIGINT AS n_shingles, least(g.doc_id, coalesce(c.y, g.doc_id)) AS component_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM g LEFT JOIN c ON c.x = g.doc_id LEFT JOIN k ON k.x = g.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_multiprobe_neighbours, op2_pairwise_quality, op3_pareto_mixing, op4_factorization_toxicity, op5_template_removal, op6_partenum_join,
        op7_boosted_url_filter, op8_bin_slack_packing, op9_layered_secrets, op10_rule_cascade,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_pareto_mixing": mixing.SQL, "op6_partenum_join": SQL6, "op10_rule_cascade": quality_rules.SQL}
