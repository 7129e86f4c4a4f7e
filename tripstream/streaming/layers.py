"""The jobs of the three layers: records to typed tables, these to clean, folded and matched ones, and those to marts.

Every function starts one job and returns its query; with wait it returns when the query has ended. Tables and
checkpoints lie under the configured root.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tripstream import settings as S
from tripstream.operators import marts, shapes
from tripstream.sources import readers
from tripstream.streaming import jobs
from tripstream.streaming.snapshot import SnapshotTable

ENVELOPE = "kafka_topic string, kafka_partition int, kafka_offset long, kafka_timestamp timestamp, kafka_key string, ingest_ts timestamp, raw_json string"
PAYLOADS = {"gps": shapes.PING, "trips": shapes.LIFECYCLE}


@dataclass(frozen=True)
class LayerConfig:
    """Where the tables lie and how often a batch begins; without a time, what is there is worked off and the job ends."""

    root: str
    processing_time: str | None = "10 seconds"
    files_per_trigger: int = 100

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def job(self, table: str) -> jobs.Job:
        return jobs.Job(table, self.root, self.processing_time)


@dataclass(frozen=True)
class RecordConfig:
    """Where records come from: a broker, or with record_path the files of readers.write_records()."""

    servers: str = "localhost:19092"
    starting: str = "earliest"
    per_trigger: int = 100_000
    topics: tuple[tuple[str, str], ...] = (("gps", S.GPS_TOPIC), ("trips", S.TRIPS_TOPIC))
    record_path: str | None = None


def _schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def _ended(query: StreamingQuery, wait: bool) -> StreamingQuery:
    if wait:
        query.awaitTermination()
    return query


def _stamped(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.current_timestamp())


def _follow(spark: SparkSession, config: LayerConfig, table: str, ddl: str, made_by: str) -> DataFrame:
    readers.require(spark, config.path(table), made_by)
    return readers.table_stream(spark, config.path(table), ddl, config.files_per_trigger)


def bronze(spark: SparkSession, config: LayerConfig, topic: str, source: RecordConfig = RecordConfig(), wait: bool = False) -> StreamingQuery:
    """Records of `gps` or `trips` to bronze_<topic>; what cannot be parsed keeps its row and its raw text."""
    name = dict(source.topics)[topic]
    if source.record_path:
        readers.require(spark, source.record_path, "the producer")
        raw = readers.record_files(spark, source.record_path, config.files_per_trigger).filter(F.col("topic") == name)
    else:
        raw = readers.kafka(spark, source.servers, name, source.starting, source.per_trigger)
    return _ended(jobs.append(config.job(f"bronze_{topic}"), shapes.parse_records(raw, PAYLOADS[topic])), wait)


def silver_gps(spark: SparkSession, config: LayerConfig, wait: bool = False) -> StreamingQuery:
    """Valid pings, one per event, to silver_gps."""
    bronze_gps = _follow(spark, config, "bronze_gps", f"{shapes.PING}, {ENVELOPE}", "bronze gps")
    return _ended(jobs.append(config.job("silver_gps"), _stamped(shapes.clean_pings(bronze_gps), "silver_processed_ts")), wait)


def trip_table(spark: SparkSession, config: LayerConfig) -> SnapshotTable:
    empty = shapes.fold_trips(spark.createDataFrame([], shapes.LIFECYCLE))
    return SnapshotTable(spark, config.path("silver_trips"), _stamped(empty, "silver_processed_ts").schema, "trip_id")


def silver_trips(spark: SparkSession, config: LayerConfig, wait: bool = False) -> StreamingQuery:
    """Lifecycle events folded and merged into silver_trips; rows without trip, time or id go to silver_trips_rejected."""
    bronze_trips = _follow(spark, config, "bronze_trips", f"{shapes.LIFECYCLE}, {ENVELOPE}", "bronze trips")
    table = trip_table(spark, config)
    table.create()

    def merge(known: DataFrame, new: DataFrame) -> DataFrame:
        return _stamped(shapes.merge_trips(known, new), "silver_processed_ts")

    return _ended(jobs.upsert_trips(config.job("silver_trips"), bronze_trips, table, merge), wait)


def silver_matched(spark: SparkSession, config: LayerConfig, wait: bool = False) -> StreamingQuery:
    """Pings of silver_gps with their trips, as silver_trips changes, to silver_matched."""
    ping_ddl = "event_id string, event_ts timestamp, trip_id string, driver_id string, lat double, lng double, speed_kmh double, heading_deg double, accuracy_m double, ingest_ts timestamp"
    gps = _follow(spark, config, "silver_gps", ping_ddl, "silver gps")
    readers.require(spark, config.path("silver_trips"), "silver trips")
    trips = trip_table(spark, config).change_stream(config.files_per_trigger).drop("silver_processed_ts")
    # a trip that changed comes again with its later times: a ping that both versions cover is one row
    matched = shapes.match_pings(gps, trips).dropDuplicatesWithinWatermark(["event_id"])
    return _ended(jobs.append(config.job("silver_matched"), _stamped(matched, "silver_processed_ts")), wait)


MATCHED = (
    "event_id string, event_ts timestamp, trip_id string, driver_id string, lat double, lng double, speed_kmh double, heading_deg double, accuracy_m double, rider_id string, "
    "trip_status string, trip_requested_ts timestamp, trip_started_ts timestamp, trip_ended_ts timestamp, pickup_lat double, pickup_lng double, dropoff_lat double, dropoff_lng double, "
    "ingest_ts timestamp"
)


def _mart(table: str, shape: Callable[[DataFrame], DataFrame], stamp: str = "gold_processed_ts"):
    def start(spark: SparkSession, config: LayerConfig, wait: bool = False) -> StreamingQuery:
        matched = _follow(spark, config, "silver_matched", MATCHED, "silver matched")
        return _ended(jobs.append(config.job(table), _stamped(shape(matched), stamp)), wait)

    start.__doc__ = f"silver_matched to {table}, each window once its watermark has passed."
    return start


active_trips = _mart("gold_active_trips", marts.active_trips)
demand_5min = _mart("gold_demand_5min", lambda m: marts.surge(marts.demand(m)))
active_trips_hex = _mart("gold_active_trips_hex", marts.active_trips_hex)
demand_hex_5min = _mart("gold_demand_hex_5min", lambda m: marts.surge(marts.demand_hex(m)))
fraud_dual_trip = _mart("gold_fraud_dual_trip", marts.dual_trips, "flagged_ts")


def fraud_teleport(spark: SparkSession, config: LayerConfig, wait: bool = False) -> StreamingQuery:
    """silver_matched to gold_fraud_teleport, a folder per batch, which a replay overwrites."""
    matched = _follow(spark, config, "silver_matched", MATCHED, "silver matched")
    flagged = jobs.teleport_stream(matched)
    return _ended(jobs.write_batches(config.job("gold_fraud_teleport"), flagged, lambda df: _stamped(df, "flagged_ts")), wait)


SILVER = {"gps": silver_gps, "trips": silver_trips, "matched": silver_matched}
GOLD = {
    "active_trips": active_trips, "demand_5min": demand_5min, "fraud_teleport": fraud_teleport, "fraud_dual_trip": fraud_dual_trip, "active_trips_hex": active_trips_hex,
    "demand_hex_5min": demand_hex_5min,
}
#: What must have run before what.
ORDER = (("bronze", "gps"), ("bronze", "trips"), ("silver", "gps"), ("silver", "trips"), ("silver", "matched"), *(("gold", m) for m in GOLD))


def run_all(spark: SparkSession, config: LayerConfig, source: RecordConfig) -> dict[str, dict]:
    """All jobs in order, each to its end, over what is there; the progress of each."""
    once = LayerConfig(config.root, None, config.files_per_trigger)
    out = {}
    for layer, name in ORDER:
        query = bronze(spark, once, name, source, True) if layer == "bronze" else (SILVER if layer == "silver" else GOLD)[name](spark, once, True)
        out[f"{layer}_{name}"] = jobs.progress(query)
    return out
