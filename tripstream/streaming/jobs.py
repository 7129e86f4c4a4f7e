"""One runner for all streaming jobs: source, shape, sink, trigger, checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tripstream.operators import marts
from tripstream.operators.shapes import fold_trips, merge_trips, quarantined
from tripstream.streaming.snapshot import SnapshotTable


@dataclass(frozen=True)
class SessionConfig:
    """What a session of this engine is made with; `conf` goes last and wins."""

    name: str = "tripstream"
    master: str | None = None
    driver_memory: str = "2g"
    shuffle_partitions: int = 4
    jars: tuple[str, ...] = ()
    conf: tuple[tuple[str, str], ...] = ()


def session(config: SessionConfig = SessionConfig()) -> SparkSession:
    """UTC, adaptive plans, and state in RocksDB, so that it may outgrow the heap; files written are of a fair size."""
    builder = SparkSession.builder.appName(config.name)
    builder = builder.master(config.master) if config.master else builder
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(config.shuffle_partitions), "spark.driver.memory": config.driver_memory,
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    if config.jars:
        conf["spark.jars"] = ",".join(config.jars)
    return builder.config(map=conf | dict(config.conf)).getOrCreate()


@dataclass(frozen=True)
class Job:
    """What runs: a stream, where its rows go and where its progress lies (under the warehouse, not the working folder)."""

    name: str
    warehouse: str
    processing_time: str | None = "10 seconds"

    @property
    def table(self) -> str:
        return f"{self.warehouse.rstrip('/')}/{self.name}"

    @property
    def checkpoint(self) -> str:
        return f"{self.warehouse.rstrip('/')}/_checkpoints/{self.name}"

    def writer(self, df: DataFrame):
        w = df.writeStream.queryName(self.name).option("checkpointLocation", self.checkpoint)
        return w.trigger(processingTime=self.processing_time) if self.processing_time else w.trigger(availableNow=True)


def append(job: Job, df: DataFrame) -> StreamingQuery:
    """Exactly once into parquet; without a processing time, whatever is there and then the end."""
    return job.writer(df).outputMode("append").format("parquet").start(job.table)


def upsert_trips(job: Job, events: DataFrame, table: SnapshotTable, merge: Callable[[DataFrame, DataFrame], DataFrame] = merge_trips) -> StreamingQuery:
    """Fold each batch and merge it; rows without a trip, a time or an id go to <table>_rejected."""

    def one(batch: DataFrame, batch_id: int) -> None:
        good, bad = quarantined(batch)
        bad.write.mode("overwrite").parquet(f"{job.table}_rejected/batch_id={batch_id}")
        table.upsert(fold_trips(good), batch_id, merge)

    return job.writer(events).foreachBatch(one).start()


def write_batches(job: Job, df: DataFrame, shape: Callable[[DataFrame], DataFrame] = lambda x: x) -> StreamingQuery:
    """A partition per batch, overwritten when a batch is replayed."""

    def one(batch: DataFrame, batch_id: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{job.table}/batch_id={batch_id}")

    return job.writer(df).foreachBatch(one).start()


_PAIR = (
    "event_id string, event_ts timestamp, driver_id string, trip_id string, prev_event_id string, prev_event_ts timestamp, prev_trip_id string, prev_lat double, prev_lng double, "
    "lat double, lng double"
)
_LAST = "event_id string, event_us long, trip_id string, lat double, lng double"


def _pairs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["event_ts", "event_id"], kind="stable").reset_index(drop=True)
    last = state.getOption
    first = {"event_id": None, "event_ts": pd.NaT, "trip_id": None, "lat": None, "lng": None}
    if last is not None:
        first = {"event_id": last[0], "event_ts": pd.Timestamp(last[1], unit="us"), "trip_id": last[2], "lat": last[3], "lng": last[4]}
    before = pd.concat([pd.DataFrame([first]), rows[["event_id", "event_ts", "trip_id", "lat", "lng"]]]).iloc[:-1].reset_index(drop=True)
    end = rows.iloc[-1]
    at = int(end.event_ts.value // 1000)
    if last is None or at >= last[1]:
        state.update((end.event_id, at, end.trip_id, float(end.lat), float(end.lng)))
    out = rows.assign(**{f"prev_{c}": before[c] for c in before.columns})
    yield out[out.prev_event_id.notna()][[c.split()[0] for c in _PAIR.split(", ")]]


def teleport_stream(matched: DataFrame) -> DataFrame:
    """Teleports with the previous ping carried over batches, in the order of arrival of batches and of time within one.

    The state is one ping per driver. It has no timeout: with one, a run over what is available never ends.
    """
    pairs = matched.select("event_id", "event_ts", "driver_id", "trip_id", "lat", "lng").groupBy("driver_id")
    return marts.flagged(pairs.applyInPandasWithState(_pairs, _PAIR, _LAST, "append", GroupStateTimeout.NoTimeout))


def compact(spark: SparkSession, path: str, target_bytes: int = 128_000_000) -> int:
    """Rewrite a batch table in files of about target_bytes, beside it, and put them in its place; how many files.

    For tables that no stream writes or reads meanwhile; the old files stay until the new ones are complete.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = max(1, -(-fs.getContentSummary(at).getLength() // target_bytes))
    beside, old = f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(beside)
    fs.delete(hadoop.Path(old), True)
    if not fs.rename(at, hadoop.Path(old)) or not fs.rename(hadoop.Path(beside), at):
        raise RuntimeError(f"{path} could not be put in place; its rows are in {old}")
    fs.delete(hadoop.Path(old), True)
    return files


def progress(query: StreamingQuery) -> dict:
    """Rows in, state rows and rows that came too late, of the last batch."""
    p = query.lastProgress
    ops = p["stateOperators"] if p else []
    return {
        "rows": p["numInputRows"] if p else 0, "state_rows": sum(o["numRowsTotal"] for o in ops), "late_rows": sum(o.get("numRowsDroppedByWatermark", 0) for o in ops),
    }


def analyst_view(matched: DataFrame, flagged: DataFrame) -> DataFrame:
    """Completed trips' pings without those of flagged drivers."""
    return matched.filter("trip_status = 'COMPLETED'").join(flagged.select("driver_id").distinct(), "driver_id", "left_anti")
