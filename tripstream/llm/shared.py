"""What the corpus operators share: column picking, cut lineage, labelled samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of rows that go to a Python worker at a time, and the setting that has them.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; other columns go, even those whose names differ in case only.

    The first column of exactly that name is taken; a missing one is an error.
    """
    at = {name: df.columns.index(name) for name in kinds}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[n]}").cast(k).alias(n) for n, k in kinds.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = set_before.get() if set_before.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tripstream-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder and read again: no lineage, and it outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these frames; nothing that still depends on them may be used after that."""
    for df in tables:
        if path := getattr(df, "cut_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on this session's rows go to Python workers some BATCH_BYTES at a time, unless it has a limit of its own.

    By default a batch has 10,000 rows of whatever size, which the executor and its worker each hold several times.
    The setting is read when a frame runs, so it can't be put back before; it cuts batches only, and no row is left out.
    """
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def give_back() -> None:
    """Called in a worker at the end of a task: memory that is free goes back to the system; else it stays with the idle worker."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id) -> F.Column:
    """True for the fifth of the ids that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, at_most: int) -> DataFrame:
    """Up to at_most labelled rows (doc_id, text, label), by the order of a hash, none of them held out.

    docs: doc_id, text. The ids number at_most or fewer, so their broadcast is bounded. Of several labels of an
    id the largest counts; of several texts each is a row (at_most bounds ids; repeated ids repeat rows).
    """
    known = pick(labels, doc_id="long", **{label: "int"}).dropna()
    some = (
        known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    )
    return docs.join(F.broadcast(some), "doc_id")
