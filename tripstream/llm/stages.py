"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame.

All but the last return the columns that docs has, in order, extra ones too; the columns used are found by their
exact names, so that names differing in case do no harm. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard_join import jaccard_join
from .mixing import mixed
from .packing import pack
from .quality import keep_good
from .secrets import redact
from .shared import cut, forget, small_batches, table

TOKENIZER = "word_bpe_49k.json"
#: Up to so many ids are broadcast.
BROADCAST_ROWS = 1_000_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _plain(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str], list[str]]:
    """docs under names that don't clash, all these names, and those of the given columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, [names[docs.columns.index(c)] for c in columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good, as they are; null and empty texts are scored too, equal texts alike."""
    small_batches(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that of the smallest doc_id.

    Rows are kept or dropped one by one: rows that repeat a doc_id, or have none (these come last), as any other.
    Texts without words are linked with nothing and stay.
    """
    small_batches(spark)
    plain, names, (doc_id, text) = _plain(docs, "doc_id", "text")
    ids = plain.groupBy(doc_id).agg(F.count("*").alias("n")).filter(F.col("n") > 1).limit(1).count() or plain.filter(F.col(doc_id).isNull()).limit(1).count()
    rows, row = (cut(plain.withColumn("row", F.monotonically_increasing_id())), "row") if ids else (plain, doc_id)
    groups = jaccard_join(rows.select(F.col(row).alias("doc_id"), F.col(text).alias("text")), shingle=5, num=4, den=5, count_links=False)
    known = groups.select(F.col("doc_id").alias("gone"), "component_id")
    if ids:
        known = known.join(rows.select(F.col("row").alias("gone"), F.col(doc_id).alias("id")), "gone")
        order = F.struct(F.col("id").isNull().alias("none"), "id", "gone")
        known = cut(known.filter(F.col("component_id").isNotNull()).withColumn("order", order))
        first = known.groupBy("component_id").agg(F.min("order").alias("first"))
        drop = known.join(first, "component_id").filter(F.col("gone") != F.col("first.gone"))
    else:
        drop = known.filter(F.col("gone") != F.col("component_id"))
    drop = cut(drop.select("gone"))
    # one number for each row that goes: few are broadcast; beyond that, the join shuffles the texts once
    side = F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop
    return rows.join(side, F.col(row) == F.col("gone"), "left_anti").select(*names).toDF(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret, nested ones too, replaced; n_chars, if docs has it, follows. A null text stays null."""
    small_batches(spark)
    clean = redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    plain, names, (text, n_chars) = _plain(clean, "text", "n_chars")
    return plain.withColumn(n_chars, F.length(text).cast(docs.schema["n_chars"].dataType)).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a null source is a source, and texts without words are taken as often as its certain copies."""
    return mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences, a row each; copies are packed each for itself, a text without words is its end id."""
    small_batches(spark)
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder, and deleted once the next one is."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
