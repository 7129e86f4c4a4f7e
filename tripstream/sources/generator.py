"""Deterministic lifecycle events and pings from raw trips, as DataFrames; random numbers are hashes of seed and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstream import settings as S
from tripstream.functions.expressions import bearing_deg, between, lerp, seeded_uuid


def _later(ts, seconds) -> F.Column:
    """Seconds after ts, cut to whole microseconds."""
    return F.timestamp_micros(F.unix_micros(ts) + F.floor(seconds * 1e6).cast("long"))


def lifecycle(trips: DataFrame, seed: int = 42) -> DataFrame:
    """trips (trip_no, pickup_ts, dropoff_ts, pickup_lat ... fare_amount_usd): requested, accepted, started, ended.

    A trip is requested before its pick-up and accepted soon after; no trip is cancelled. The order across trips is
    that of trips, so that event time jumps back from one trip to the next.
    """
    s = F.lit(seed)
    ids = trips.withColumns({"trip_id": seeded_uuid(s, "trip_no"), "rider_id": seeded_uuid(s, F.lit("r"), "trip_no"), "driver": seeded_uuid(s, F.lit("d"), "trip_no")})
    ids = ids.withColumn("asked", _later("pickup_ts", -between(*S.REQUEST_SECONDS, s, "trip_no", F.lit("q"))))
    taken = _later("asked", between(*S.ACCEPT_SECONDS, s, "trip_no", F.lit("a")))
    none = F.lit(None).cast("string")

    def step(name, at, driver):
        return F.struct(F.lit(name).alias("event_type"), at.alias("event_ts"), driver.alias("driver_id"))

    driver = F.col("driver")
    steps = F.array(
        step("trip_requested", F.col("asked"), none), step("trip_accepted", taken, driver), step("trip_started", F.col("pickup_ts"), driver),
        step("trip_ended", F.col("dropoff_ts"), driver),
    )
    out = ids.withColumn("e", F.explode(steps)).select("*", "e.event_type", "e.event_ts", "e.driver_id")
    done = F.col("event_type") == "trip_ended"
    return out.select(
        seeded_uuid(s, "trip_no", "event_type").alias("event_id"), "event_ts", "event_type", "trip_id", "rider_id", "driver_id",
        "pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng", F.when(done, F.col("trip_distance_km")).alias("trip_distance_km"),
        F.when(done, F.col("fare_amount_usd")).alias("fare_amount_usd"), none.alias("cancelled_by"),
    )


def pings(trips: DataFrame, every_seconds: float = 1.0, seed: int = 42, most: int = S.MOST_PINGS) -> DataFrame:
    """One position every so many seconds from pick-up on, `most` per trip at most, at least one.

    Point i of n lies at the fraction i / n of the straight way. A trip without duration has speed 0, but for noise.
    """
    s = F.lit(seed)
    micros = F.unix_micros("dropoff_ts") - F.unix_micros("pickup_ts")
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(micros / (every_seconds * 1e6)).cast("int")))
    df = trips.withColumn("n", n).withColumn("micros", micros).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    f = F.col("i") / F.col("n")
    noise = lambda k, most: between(-most, most, s, "trip_no", "i", F.lit(k))
    average = F.when(F.col("micros") > 0, F.col("trip_distance_km") / (F.col("micros") / 3.6e9)).otherwise(0.0)
    return df.select(
        seeded_uuid(s, "trip_no", F.lit("ping"), "i").alias("event_id"), _later("pickup_ts", F.col("i") * F.lit(float(every_seconds))).alias("event_ts"),
        F.lit("gps_ping").alias("event_type"), seeded_uuid(s, "trip_no").alias("trip_id"), seeded_uuid(s, F.lit("d"), "trip_no").alias("driver_id"),
        (lerp("pickup_lat", "dropoff_lat", f) + noise("y", S.DEGREE_NOISE)).alias("lat"), (lerp("pickup_lng", "dropoff_lng", f) + noise("x", S.DEGREE_NOISE)).alias("lng"),
        F.round(F.greatest(F.lit(0.0), average + noise("v", S.SPEED_NOISE)), 2).alias("speed_kmh"),
        F.round(bearing_deg("pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng"), 2).alias("heading_deg"),
        F.round(between(3.0, 12.0, s, "trip_no", "i", F.lit("m")), 2).alias("accuracy_m"),
    )


def events(trips: DataFrame, every_seconds: float = 1.0, seed: int = 42) -> DataFrame:
    """All of a trip's events under one schema."""
    return lifecycle(trips, seed).unionByName(pings(trips, every_seconds, seed), allowMissingColumns=True)
