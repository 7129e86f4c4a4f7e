"""Readers, batch or streaming, with fixed schemas; writers of the same layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstream import settings as S
from tripstream.functions.expressions import jitter_point, topic_of, utc_hour_parts

TRIP = (
    "pickup_ts timestamp, dropoff_ts timestamp, pickup_lat double, pickup_lng double, dropoff_lat double, dropoff_lng double, trip_distance_km double, fare_amount_usd double"
)
#: Times in JSON keep their microseconds.
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
RECORD = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, timestampType int"


def kafka(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", per_trigger: int = 100_000, **options) -> DataFrame:
    """A topic as a stream of RECORD rows; needs Spark's Kafka package. Lost data fails the query."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.option("startingOffsets", starting).option("maxOffsetsPerTrigger", per_trigger).options(**options).load()


def record_files(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """The same rows from parquet files, where there is no broker."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", per_trigger).parquet(path)


def table_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New files of an append-only table, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def require(spark: SparkSession, path: str, made_by: str) -> None:
    """Fail at once, naming the job that should have made the table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path} does not exist; run {made_by} first")


def event_files(spark: SparkSession, base: str, payload: str, types: list[str] | None = None, stream: bool = False) -> DataFrame:
    """JSON lines under event_type=/year=/month=/day=/hour=; types prunes partitions."""
    reader = (spark.readStream if stream else spark.read).format("json").schema(payload).option("basePath", base)
    df = reader.load(base)
    df = df.filter(F.col("event_type").isin(types)) if types else df
    return df.withColumn("ingest_ts", F.current_timestamp()).withColumn("source_system", F.lit("delivery-stream"))


def write_event_files(df: DataFrame, base: str) -> None:
    """Partitioned by type and UTC hour of the event, zero-padded; the payload keeps event_type."""
    parts = utc_hour_parts("event_ts")
    plain = df.withColumns(parts).withColumn("_type", F.col("event_type"))
    body = F.to_json(F.struct(*df.columns), JSON_TIMES).alias("value")
    plain.select(body, F.col("_type").alias("event_type"), *parts).write.mode("append").partitionBy("event_type", *parts).text(base)


def to_records(events: DataFrame, gps: str = S.GPS_TOPIC, trips: str = S.TRIPS_TOPIC) -> DataFrame:
    """Events as JSON records with the topic each belongs to; the key keeps a trip's records in one partition, in order."""
    value = F.to_json(F.struct(*events.columns), JSON_TIMES).cast("binary")
    return events.select(topic_of(gps=gps, trips=trips).alias("topic"), F.col("trip_id").cast("binary").alias("key"), value.alias("value"))


def send(events: DataFrame, servers: str, **options) -> int:
    """Write a batch of events to their topics and wait for all to be acknowledged; how many. Needs Spark's Kafka package.

    Spark's producer retries, and a record that is not taken fails the job.
    """
    records = to_records(events)
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).options(**{"kafka.acks": "all", "kafka.compression.type": "snappy"} | options).save()
    return records.count()


def write_records(events: DataFrame, path: str) -> None:
    """The same records as files that record_files() follows, where there is no broker."""
    rows = to_records(events).select(
        "key", "value", "topic", F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"), F.current_timestamp().alias("timestamp"), F.lit(0).alias("timestampType")
    )
    rows.write.mode("append").partitionBy("topic").parquet(path)


def json_lines(events: DataFrame) -> DataFrame:
    """One JSON object a row, for write.text() or printing; absent fields are left out."""
    return events.select(F.to_json(F.struct(*events.columns), JSON_TIMES).alias("value"))


def memory_trips(spark: SparkSession, trips: list[tuple], limit: int = 0) -> DataFrame:
    """Trips from a list, in its order; limit 0 takes all."""
    some = trips[:limit] if limit else trips
    return spark.createDataFrame([(i, *t) for i, t in enumerate(some)], f"trip_no long, {TRIP}")


def zones(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    df = spark.read.schema("LocationID int, Borough string, Zone string, service_zone string").csv(path, header=True)
    return df.filter(F.col("Borough").isin(known)).select("LocationID", "Borough")


def raw_trips(hires: DataFrame, zone_table: DataFrame, seed: int = 42, limit: int = 0) -> DataFrame:
    """Hire records to trips (trip_no, TRIP): both zones known, drop-off after pick-up and within four hours, km for miles,
    fares not negative, null miles and fares 0. Times without a zone are UTC. limit 0 takes all.

    Pick-up and drop-off lie in their zones' disks, where a hash of the record and the seed puts them; trip_no is a
    hash of the record too, so that a record is the same trip in every run. zone_table (LocationID, Borough) has a
    row per zone of a city, a few hundred; it is broadcast twice.
    """
    a = F.broadcast(zone_table.select(F.col("LocationID").alias("PULocationID"), F.col("Borough").alias("pickup_borough")))
    b = F.broadcast(zone_table.select(F.col("LocationID").alias("DOLocationID"), F.col("Borough").alias("dropoff_borough")))
    df = hires.select("pickup_datetime", "dropoff_datetime", "PULocationID", "DOLocationID", "trip_miles", "base_passenger_fare")
    df = df.join(a, "PULocationID").join(b, "DOLocationID")
    plain = dict(hires.dtypes)["pickup_datetime"] == "timestamp_ntz"
    at = lambda c: F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', {c})")) if plain else F.col(c).cast("timestamp")
    df = df.withColumns({"pickup_ts": at("pickup_datetime"), "dropoff_ts": at("dropoff_datetime")})
    df = df.filter(f"dropoff_ts > pickup_ts and dropoff_ts <= pickup_ts + interval {S.LONGEST_HIRE}")
    keys = [F.unix_micros("pickup_ts"), F.unix_micros("dropoff_ts"), F.col("PULocationID"), F.col("DOLocationID"), F.col("trip_miles"), F.col("base_passenger_fare")]
    df = df.withColumn("trip_no", F.xxhash64(*keys))
    p, d = jitter_point("pickup_borough", F.lit(seed), F.lit("p"), *keys[:4]), jitter_point("dropoff_borough", F.lit(seed), F.lit("d"), *keys[:4])
    out = df.select(
        "trip_no", "pickup_ts", "dropoff_ts", p[0].alias("pickup_lat"), p[1].alias("pickup_lng"), d[0].alias("dropoff_lat"), d[1].alias("dropoff_lng"),
        (F.coalesce("trip_miles", F.lit(0.0)) * S.KM_PER_MILE).alias("trip_distance_km"), F.greatest(F.coalesce("base_passenger_fare", F.lit(0.0)), F.lit(0.0)).alias("fare_amount_usd"),
        "pickup_borough", "dropoff_borough",
    )
    return out.limit(limit) if limit else out


def hire_files(spark: SparkSession, path: str, zone_path: str, seed: int = 42, limit: int = 0) -> DataFrame:
    """raw_trips() of parquet hire records and a zone lookup; only the six columns used are read."""
    return raw_trips(spark.read.parquet(path), zones(spark, zone_path, list(S.ZONES)), seed, limit)
