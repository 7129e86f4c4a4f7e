"""Windowed marts and anomaly signals over matched pings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripstream import settings as S
from tripstream.functions.expressions import haversine_km, hex_cell, implied_kmh, zone_of


def windowed(df: DataFrame, window: str, keys: list[str], measures: dict, watermark: str = S.MART_WATERMARK) -> DataFrame:
    """Measures per tumbling window of event_ts and keys; window_start, window_end first."""
    if df.isStreaming:
        df = df.withWatermark("event_ts", watermark)
    out = df.groupBy(F.window("event_ts", window).alias("w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *measures)


def _distinct(df: DataFrame, column: str) -> F.Column:
    """Exact in batch; streams allow an estimate only (exact_distinct_stream() is the exact way there)."""
    return F.approx_count_distinct(column) if df.isStreaming else F.count_distinct(column)


def active_trips(matched: DataFrame) -> DataFrame:
    df = matched.filter("trip_status = 'IN_PROGRESS'").withColumn("borough", zone_of()).filter("borough is not null")
    return windowed(df, S.ACTIVE_WINDOW, ["borough"], {"active_trips": _distinct(df, "trip_id").cast("int")})


def _demand(df: DataFrame, unique_pings: bool) -> dict:
    """unique_pings: no event_id occurs twice, so that batch counts them before the shuffle instead of moving every id."""
    pings = F.count("event_id") if unique_pings and not df.isStreaming else _distinct(df, "event_id")
    return {"ping_count": pings, "distinct_trips": _distinct(df, "trip_id"), "distinct_drivers": _distinct(df, "driver_id")}


def demand(matched: DataFrame, unique_pings: bool = False) -> DataFrame:
    df = matched.withColumn("borough", zone_of()).filter("borough is not null")
    return windowed(df, S.DEMAND_WINDOW, ["borough"], _demand(df, unique_pings))


def active_trips_hex(matched: DataFrame, cell=hex_cell) -> DataFrame:
    df = matched.filter("trip_status = 'IN_PROGRESS'").withColumn("cell", cell()).withColumn("borough", zone_of()).filter("cell is not null")
    return windowed(df, S.ACTIVE_WINDOW, ["cell", "borough"], {"active_trips": _distinct(df, "trip_id").cast("int")})


def demand_hex(matched: DataFrame, cell=hex_cell, unique_pings: bool = False) -> DataFrame:
    df = matched.withColumn("cell", cell()).withColumn("borough", zone_of()).filter("cell is not null")
    return windowed(df, S.DEMAND_WINDOW, ["cell", "borough"], _demand(df, unique_pings))


def surge(demand_rows: DataFrame) -> DataFrame:
    """distinct_trips over distinct_drivers (1 at least)."""
    return demand_rows.withColumn("surge", F.col("distinct_trips") / F.greatest("distinct_drivers", F.lit(1)))


def dual_trips(matched: DataFrame) -> DataFrame:
    """Drivers on more than one trip in a window, with the first few trip ids; counted from the set, so exact in streams too."""
    out = windowed(matched, S.FRAUD_WINDOW, ["driver_id"], {"trips": F.collect_set("trip_id")}).filter(F.size("trips") > 1)
    return out.select("window_start", "window_end", "driver_id", F.size("trips").alias("concurrent_trip_count"), F.slice(F.sort_array("trips"), 1, S.SAMPLE_TRIPS).alias("sample_trip_ids"))


def teleports(matched: DataFrame) -> DataFrame:
    """Pings too far from the driver's previous one for the time between; ties in time go by event_id. Batch only.

    Pings are ordered within a driver's day; the first of a day follows the last of the driver's latest day before,
    so that no task sorts a driver's whole history.
    """
    columns = ("event_ts", "event_id", "trip_id", "lat", "lng")
    df = matched.select("driver_id", *columns, F.expr("unix_micros(event_ts) div 86400000000").alias("day"))
    ping = F.struct(*columns)
    days = df.groupBy("driver_id", "day").agg(F.max(ping).alias("last"))
    days = days.select(F.col("driver_id").alias("d"), F.col("day").alias("e"), F.lag("last").over(Window.partitionBy("driver_id").orderBy("day")).alias("before"))
    df = df.withColumn("prev", F.lag(ping).over(Window.partitionBy("driver_id", "day").orderBy("event_ts", "event_id")))
    df = df.join(days, F.col("driver_id").eqNullSafe(F.col("d")) & F.col("day").eqNullSafe(F.col("e")), "left").withColumn("prev", F.coalesce("prev", "before"))
    df = df.select("event_id", "event_ts", "driver_id", "trip_id", *[F.col(f"prev.{c}").alias(f"prev_{c}") for c in ("event_id", "event_ts", "trip_id", "lat", "lng")], "lat", "lng")
    return flagged(df.filter("prev_event_id is not null"))


def flagged(pairs: DataFrame) -> DataFrame:
    """Of pairs of pings, those that break the limits of speed, time and distance."""
    seconds = (F.unix_micros("event_ts") - F.unix_micros("prev_event_ts")) / 1e6
    df = pairs.withColumn("distance_km", haversine_km("prev_lat", "prev_lng", "lat", "lng")).withColumn("time_delta_seconds", seconds)
    df = df.withColumn("implied_speed_kmh", implied_kmh("distance_km", "time_delta_seconds"))
    return df.filter((F.col("implied_speed_kmh") > S.TELEPORT_KMH) & (F.col("time_delta_seconds") >= S.TELEPORT_SECONDS) & (F.col("distance_km") >= S.TELEPORT_KM))


def exact_distinct_stream(df: DataFrame, window: str, keys: list[str], column: str, name: str, watermark: str = S.MART_WATERMARK) -> DataFrame:
    """Exact distinct counts per window in a stream: duplicates within a window go first, then rows are counted."""
    df = df.withWatermark("event_ts", watermark).withColumn("w", F.window("event_ts", window))
    once = df.select("w", *keys, column).dropDuplicates(["w", *keys, column])
    return once.groupBy("w", *keys).agg(F.count(column).alias(name)).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, name)


def sketches(matched: DataFrame) -> DataFrame:
    """Mergeable sketches of trips per window, cell and zone."""
    df = matched.withColumn("cell", hex_cell()).withColumn("borough", zone_of()).filter("cell is not null")
    return windowed(df, S.DEMAND_WINDOW, ["cell", "borough"], {"trips": F.hll_sketch_agg("trip_id")})


def rolled_up(sketched: DataFrame) -> DataFrame:
    """Distinct trips per window and zone from the cells' sketches; summing the cells' counts would count trips twice."""
    out = sketched.groupBy("window_start", "window_end", "borough").agg(F.hll_union_agg("trips").alias("trips"))
    return out.select("window_start", "window_end", "borough", F.hll_sketch_estimate("trips").alias("distinct_trips"))


def top(df: DataFrame, by: str, n: int = 10, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)
