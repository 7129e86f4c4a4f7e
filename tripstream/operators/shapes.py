"""DataFrame to DataFrame shapes from raw records to trip facts and matched pings; the same in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstream import settings as S
from tripstream.functions.expressions import trip_status, valid_ping

PING = "event_id string, event_ts timestamp, event_type string, trip_id string, driver_id string, lat double, lng double, speed_kmh double, heading_deg double, accuracy_m double"
LIFECYCLE = (
    "event_id string, event_ts timestamp, event_type string, trip_id string, rider_id string, driver_id string, pickup_lat double, pickup_lng double, "
    "dropoff_lat double, dropoff_lng double, trip_distance_km double, fare_amount_usd double, cancelled_by string"
)
MATCHED = [
    "event_id", "event_ts", "trip_id", "driver_id", "lat", "lng", "speed_kmh", "heading_deg", "accuracy_m", "rider_id", "trip_status", "trip_requested_ts",
    "trip_started_ts", "trip_ended_ts", "pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng", "ingest_ts",
]
_TIMES = {"trip_requested": "requested_ts", "trip_accepted": "accepted_ts", "trip_started": "started_ts", "trip_ended": "ended_ts", "trip_cancelled": "cancelled_ts"}
_PLACES = ("pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng")


def parse_records(raw: DataFrame, payload: str) -> DataFrame:
    """Records of a log (key, value, topic, partition, offset, timestamp) to payload columns, envelope and raw_json.

    A record that can't be parsed keeps its row, with a null payload.
    """
    text = F.col("value").cast("string")
    return raw.select(
        F.from_json(text, payload).alias("p"), F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"),
        F.col("offset").alias("kafka_offset"), F.col("timestamp").alias("kafka_timestamp"), F.col("key").cast("string").alias("kafka_key"),
        F.current_timestamp().alias("ingest_ts"), text.alias("raw_json"),
    ).select("p.*", "kafka_topic", "kafka_partition", "kafka_offset", "kafka_timestamp", "kafka_key", "ingest_ts", "raw_json")


def quarantined(bronze: DataFrame, required: tuple[str, ...] = ("event_id", "event_ts", "trip_id")) -> tuple[DataFrame, DataFrame]:
    """(rows that have all required fields, the others)."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return bronze.filter(ok), bronze.filter(~ok)


def clean_pings(bronze: DataFrame, watermark: str = S.PING_WATERMARK, dedup_first: bool = False) -> DataFrame:
    """Valid pings, one per event_id.

    The filter comes first: it reaches the scan, and a bad copy does not shadow a good one. dedup_first takes the
    other order. In a stream, duplicates within the watermark go and state is dropped behind it.
    """
    def one(df: DataFrame) -> DataFrame:
        if df.isStreaming:
            return df.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
        return df.dropDuplicates(["event_id"])

    df = one(bronze).filter(valid_ping()) if dedup_first else one(bronze.filter(valid_ping()))
    return df.select("event_id", "event_ts", "trip_id", "driver_id", "lat", "lng", "speed_kmh", "heading_deg", "accuracy_m", "ingest_ts")


def fold_trips(events: DataFrame) -> DataFrame:
    """One row per trip from its lifecycle events; partial aggregates run before the shuffle."""
    kind = F.col("event_type")
    at = lambda name, c: F.max(F.when(kind == name, F.col(c)))
    folded = events.groupBy("trip_id").agg(
        F.max("rider_id").alias("rider_id"), F.max("driver_id").alias("driver_id"), *[at(n, "event_ts").alias(c) for n, c in _TIMES.items()],
        *[at("trip_requested", c).alias(c) for c in _PLACES], at("trip_ended", "trip_distance_km").alias("trip_distance_km"),
        at("trip_ended", "fare_amount_usd").alias("fare_amount_usd"), at("trip_cancelled", "cancelled_by").alias("cancelled_by"),
        F.min("event_ts").alias("first_event_ts"), F.max("event_ts").alias("last_event_ts"),
    )
    return folded.withColumn("status", trip_status())


def merge_trips(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known facts with a batch's fold merged in.

    What is known stays, but for driver_id, where the newer wins; first and last event widen; the status follows
    the merged times; rider_id never changes; unknown trips are added as they are.
    """
    k, n = known.alias("k"), new.alias("n")
    both = k.join(n, F.col("k.trip_id") == F.col("n.trip_id"), "full_outer")
    older = lambda c: F.coalesce(F.col(f"k.{c}"), F.col(f"n.{c}")).alias(c)
    rider = F.when(F.col("k.trip_id").isNotNull(), F.col("k.rider_id")).otherwise(F.col("n.rider_id")).alias("rider_id")
    merged = both.select(
        older("trip_id"), rider, F.coalesce("n.driver_id", "k.driver_id").alias("driver_id"), *[older(c) for c in _TIMES.values()],
        *[older(c) for c in (*_PLACES, "trip_distance_km", "fare_amount_usd", "cancelled_by")],
        F.least("k.first_event_ts", "n.first_event_ts").alias("first_event_ts"), F.greatest("k.last_event_ts", "n.last_event_ts").alias("last_event_ts"),
    )
    return merged.withColumn("status", trip_status())


def match_pings(pings: DataFrame, trips: DataFrame, open_ended: bool = False, span: str = S.TRIP_SPAN) -> DataFrame:
    """Pings with the trip they belong to: within the trip's time and slack, on started trips that weren't cancelled.

    open_ended: a trip in progress has no upper bound. In streams both sides get watermarks, and bounds between the
    two watermarked columns are added (implied above, `span` below), so that old state is evicted.
    """
    g, t = pings, trips.filter("started_ts is not null and cancelled_ts is null")
    streams = g.isStreaming or t.isStreaming
    if streams:
        g, t = g.withWatermark("event_ts", S.PING_WATERMARK), t.withWatermark("last_event_ts", S.TRIP_WATERMARK)
    g, t = g.alias("g"), t.alias("t")
    upper = f"g.event_ts <= coalesce(t.ended_ts, t.last_event_ts) + interval {S.END_SLACK}"
    upper = f"(t.ended_ts is null or {upper})" if open_ended else upper
    on = f"g.trip_id = t.trip_id and g.event_ts >= t.started_ts - interval {S.START_SLACK} and {upper}"
    if streams:
        on += f" and g.event_ts >= t.last_event_ts - interval {span} and g.event_ts <= t.last_event_ts + interval {span if open_ended else S.END_SLACK}"
    own = {"trip_status": "status", "trip_requested_ts": "requested_ts", "trip_started_ts": "started_ts", "trip_ended_ts": "ended_ts"}
    side = lambda c: F.col(f"t.{own.get(c, c)}" if c in own or c == "rider_id" or c in _PLACES else f"g.{c}").alias(c)
    return g.join(t, F.expr(on)).select(*[side(c) for c in MATCHED])
