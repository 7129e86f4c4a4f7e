"""A keyed table in buckets of parquet: upserts rewrite the buckets they touch, are atomic, and merge a batch once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets by a hash of the key; a batch rewrites those that its keys are in.
BUCKETS = 64
#: Versions whose files vacuum() leaves, for readers that have begun.
KEEP = 3


class SnapshotTable:
    """path/_log/<version>.json names the batch, the folder of each bucket and the changes; data folders have unique names.

    A version counts once its log file is there; that file is written beside and then renamed, so that no reader
    sees half of it and of two writers one fails. changes/ has the rows of every version's touched keys and can be
    followed by a stream; an upsert that fails before its log entry may leave its changes there a second time.
    """

    def __init__(self, spark: SparkSession, path: str, schema, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def _versions(self) -> list[str]:
        log = self._at("_log")
        if not self._fs.exists(log):
            return []
        return sorted(n for f in self._fs.listStatus(log) if (n := f.getPath().getName()).endswith(".json") and not n.startswith("."))

    def _entry(self, name: str) -> dict:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/_log/{name}").collect()))

    def _last(self) -> tuple[int, dict]:
        names = self._versions()
        return (int(names[-1][:-5]), self._entry(names[-1])) if names else (-1, {"batch": -1, "buckets": {}})

    def version(self) -> tuple[int, int]:
        """The last version and the batch that made it; -1, -1 for none."""
        version, entry = self._last()
        return version, entry["batch"]

    def create(self) -> None:
        """An empty table, if there is none yet."""
        if not self._versions():
            self._commit(0, {"batch": -1, "buckets": {}, "changes": None})

    def _commit(self, version: int, entry: dict) -> None:
        final, beside = self._at("_log", f"{version:020d}.json"), self._at("_log", f".{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(beside, final):
            self._fs.delete(beside, False)
            raise RuntimeError(f"{self.path}: another writer made version {version}")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self) -> DataFrame:
        return self._read(sorted(self._last()[1]["buckets"].values()))

    def changes(self) -> DataFrame:
        """Rows of the keys that the last version touched, and no others."""
        folder = self._last()[1].get("changes")
        return self._read([folder] if folder else [])

    def change_stream(self, per_trigger: int = 100) -> DataFrame:
        """Rows of the keys that each version touched, one version after the other, none skipped."""
        self._fs.mkdirs(self._at("changes"))
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").parquet(f"{self.path}/changes")

    def upsert(self, batch: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Merge a folded batch; False if that batch, or a later one, is in the table already."""
        version, entry = self._last()
        if batch_id <= entry["batch"]:
            return False
        columns = [f.name for f in self.schema.fields]
        bucket = F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets))
        new = f"changes/{version + 1:020d}-{uuid.uuid4().hex}"
        folded = f"data/{uuid.uuid4().hex}"
        batch.write.parquet(f"{self.path}/{folded}")  # read twice below
        batch = self.spark.read.schema(batch.schema).parquet(f"{self.path}/{folded}")
        touched = [int(r[0]) for r in batch.select(bucket).distinct().collect()]  # BUCKETS at most
        known = self._read([entry["buckets"][str(b)] for b in touched if str(b) in entry["buckets"]])
        data = f"data/{uuid.uuid4().hex}"
        merged = merge(known, batch).select(columns).withColumn("_bucket", bucket)
        merged.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{data}")
        buckets = entry["buckets"] | {str(b): f"{data}/_bucket={b}" for b in touched}
        keys = batch.select(F.col(self.key)).distinct()
        self._read([buckets[str(b)] for b in touched]).join(keys, self.key, "left_semi").select(columns).write.parquet(f"{self.path}/{new}")
        self._commit(version + 1, {"batch": batch_id, "buckets": buckets, "changes": new})
        self._fs.delete(self._at(folded), True)
        return True

    def vacuum(self, keep: int = KEEP) -> int:
        """Delete data folders that none of the last `keep` versions names; how many. Changes stay for the streams."""
        names = self._versions()[-keep:]
        used = {folder.split("/_bucket")[0] for n in names for folder in self._entry(n)["buckets"].values()}
        gone = 0
        if names and self._fs.exists(self._at("data")):
            for f in self._fs.listStatus(self._at("data")):
                if f"data/{f.getPath().getName()}" not in used:
                    gone += int(self._fs.delete(f.getPath(), True))
        return gone
