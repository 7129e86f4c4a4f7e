"""Queries over sources, the generator and record handling, and the same in SQL; see registry for the others."""

from __future__ import annotations

from math import cos, pi, radians

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstream import settings as S
from tripstream.functions.expressions import bearing_deg, jitter_point, zone_of
from tripstream.operators import marts, shapes
from tripstream.plans import bridge as B
from tripstream.sources import generator, readers

SEED = 42
EVERY = 60.0


def micros(df: DataFrame) -> DataFrame:
    """Timestamps as longs, named _us."""
    kinds = dict(df.dtypes)
    name = lambda c: (c[:-3] if c.endswith("_ts") else c) + "_us"
    return df.select(*[F.unix_micros(c).alias(name(c)) if kinds[c].startswith("timestamp") else F.col(c) for c in df.columns])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _hires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hire records: some of unknown zones, some that end before they begin or last too long."""
    e = B.events(spark, sf_dir)
    return e.select(
        F.col("event_ts").alias("pickup_datetime"), F.timestamp_micros(F.unix_micros("event_ts") + F.expr("(n * 37 % 20000 - 200) * 1000000")).alias("dropoff_datetime"),
        F.expr("cast(n % 8 + 1 as int)").alias("PULocationID"), F.expr("cast(n * 3 % 8 + 1 as int)").alias("DOLocationID"),
        F.col("speed_kmh").alias("trip_miles"), (F.col("speed_kmh") - 10).alias("base_passenger_fare"),
    )


def hire_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = spark.createDataFrame([(i, z) for i, z in enumerate(S.ZONES, 1)], "LocationID int, Borough string")
    return rounded(micros(readers.raw_trips(_hires(spark, sf_dir), zones, SEED).drop("trip_no")))


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a trip of its own, up to some 33 minutes long, a few without duration."""
    e = B.events(spark, sf_dir)
    return e.select(
        F.col("n").alias("trip_no"), F.col("event_ts").alias("pickup_ts"), F.timestamp_micros(F.unix_micros("event_ts") + F.expr("n * 37 % 2000 * 1000000")).alias("dropoff_ts"),
        F.col("lat").alias("pickup_lat"), F.col("lng").alias("pickup_lng"), (F.col("lat") + 0.05).alias("dropoff_lat"), (F.col("lng") - 0.03).alias("dropoff_lng"),
        F.col("accuracy_m").alias("trip_distance_km"), (F.col("accuracy_m") * 2).alias("fare_amount_usd"),
    )


def generated_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(micros(generator.lifecycle(_trips(spark, sf_dir), SEED).drop("cancelled_by")))


def generated_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(micros(generator.pings(_trips(spark, sf_dir), EVERY, SEED).drop("event_type")))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events and pings as records of their topics, read back from the JSON."""
    e = B.events(spark, sf_dir).withColumn("event_type", F.when(F.col("n") % 3 == 0, "gps_ping").otherwise(F.col("event_type")))
    text = F.col("value").cast("string")
    out = readers.to_records(e.select("event_id", "event_ts", "event_type", "trip_id", "lat", "speed_kmh"))
    fields = {c: F.get_json_object(text, f"$.{c}") for c in ("event_id", "event_type", "event_ts")}
    at = F.unix_micros(fields["event_ts"].cast("timestamp")).alias("event_us")
    return out.select("topic", F.col("key").cast("string").alias("key"), fields["event_id"].alias("event_id"), fields["event_type"].alias("event_type"), at)


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle events that lack a required field, here the driver."""
    bad = shapes.quarantined(B.lifecycle(spark, sf_dir), ("event_id", "event_ts", "driver_id"))[1]
    return micros(bad.select("event_id", "event_ts", "event_type", "trip_id"))


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events(spark, sf_dir).filter(F.col("event_type").isin("trip_started", "trip_ended")).select("event_id", "event_type", F.lit("log").alias("source_system"))


def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.events(spark, sf_dir).select("event_id", F.round(bearing_deg(F.lit(40.758), F.lit(-73.9855), "lat", "lng"), 6).alias("heading_deg"))


def jittered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = B.events(spark, sf_dir).withColumn("zone", zone_of())
    lat, lng = jitter_point("zone", F.lit(SEED), F.col("event_id"))
    return rounded(e.filter("zone is not null").select("event_id", "zone", lat.alias("lat"), lng.alias("lng")))


def memory_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    rows = [(datetime(2024, 1, 1, 8, i), datetime(2024, 1, 1, 9, i), 40.7, -74.0, 40.8, -73.9, float(i), 2.0 * i) for i in range(8)]
    return micros(readers.memory_trips(spark, rows, limit=5))


def top_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    pings = shapes.clean_pings(B.events(spark, sf_dir)).withColumn("zone", zone_of()).filter("zone is not null")
    return marts.top(pings.groupBy("zone").agg(F.count("*").alias("pings")), "pings", 3, "zone")


_EAST = S.KM_PER_DEGREE * cos(radians(S.MID_LATITUDE))


def _unit_sql(*keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)!r}::DOUBLE)"


def _uuid_sql(*keys: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(keys)}))"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def _between_sql(low: float, high: float, *keys: str) -> str:
    return f"({low!r}::DOUBLE + {high - low!r}::DOUBLE * {_unit_sql(*keys)})"


def _point_sql(zone: str, *keys: str) -> tuple[str, str]:
    of = lambda values: "CASE " + zone + "".join(f" WHEN '{n}' THEN {float(v)!r}::DOUBLE" for n, v in values.items()) + " END"
    r = f"(({of(S.ZONE_RADIUS_KM)}) * sqrt({_unit_sql(*keys, chr(39) + 'r' + chr(39))}))"
    t = f"({_unit_sql(*keys, chr(39) + 't' + chr(39))} * {2 * pi!r}::DOUBLE)"
    lat, lng = of({n: a for n, (a, _) in S.ZONES.items()}), of({n: b for n, (_, b) in S.ZONES.items()})
    return f"({lat}) + {r} * sin({t}) / 111.0::DOUBLE", f"({lng}) + {r} * cos({t}) / {_EAST!r}::DOUBLE"


def _bearing_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    x = f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * cos(radians({lng2} - ({lng1})))"
    d = f"(degrees(atan2(sin(radians({lng2} - ({lng1}))) * cos(radians({lat2})), {x})) + 360.0::DOUBLE)"
    return f"CASE WHEN {d} >= 360 THEN {d} - 360 ELSE {d} END"


_ZONE = B.zone_sql()
_HIRE_KEYS = ("us", "drop_us", "pu", "dz")
_P, _D = (_point_sql(z, f"{SEED}", f"'{k}'", *_HIRE_KEYS) for z, k in (("pz", "p"), ("qz", "d")))
_ZONE_OF = lambda c: "CASE " + c + "".join(f" WHEN {i} THEN '{z}'" for i, z in enumerate(S.ZONES, 1)) + " END"
HIRE_SQL = f"""WITH {B.SQL},
h AS (SELECT us, us + (n * 37 % 20000 - 200) * 1000000 AS drop_us, n % 8 + 1 AS pu, n * 3 % 8 + 1 AS dz, speed_kmh FROM ev),
z AS (SELECT *, {_ZONE_OF("pu")} AS pz, {_ZONE_OF("dz")} AS qz FROM h WHERE drop_us > us AND drop_us <= us + 14400000000)
SELECT us AS pickup_us, drop_us AS dropoff_us, round({_P[0]}, 6) AS pickup_lat, round({_P[1]}, 6) AS pickup_lng, round({_D[0]}, 6) AS dropoff_lat, round({_D[1]}, 6) AS dropoff_lng,
  round(coalesce(speed_kmh, 0) * 1.609344::DOUBLE, 6) AS trip_distance_km, round(greatest(coalesce(speed_kmh - 10, 0), 0), 6) AS fare_amount_usd, pz AS pickup_borough, qz AS dropoff_borough
FROM z WHERE pz IS NOT NULL AND qz IS NOT NULL"""

_TRIPS = f"""{B.SQL},
g AS (SELECT n AS trip_no, us AS pickup_us, us + n * 37 % 2000 * 1000000 AS dropoff_us, lat AS pickup_lat, lng AS pickup_lng, lat + 0.05::DOUBLE AS dropoff_lat, lng - 0.03::DOUBLE AS dropoff_lng,
  accuracy_m AS trip_distance_km, accuracy_m * 2 AS fare_amount_usd FROM ev)"""
_S = str(SEED)
_ASKED = f"pickup_us + floor(-{_between_sql(*S.REQUEST_SECONDS, _S, 'trip_no', chr(39) + 'q' + chr(39))} * 1e6::DOUBLE)::BIGINT"
_TAKEN = f"asked + floor({_between_sql(*S.ACCEPT_SECONDS, _S, 'trip_no', chr(39) + 'a' + chr(39))} * 1e6::DOUBLE)::BIGINT"
LIFECYCLE_SQL = f"""WITH {_TRIPS},
a AS (SELECT *, {_ASKED} AS asked FROM g),
k AS (SELECT *, 'trip_requested' AS event_type, asked AS event_us FROM a UNION ALL SELECT *, 'trip_accepted', {_TAKEN} FROM a
  UNION ALL SELECT *, 'trip_started', pickup_us FROM a UNION ALL SELECT *, 'trip_ended', dropoff_us FROM a)
SELECT {_uuid_sql(_S, "trip_no", "event_type")} AS event_id, event_us, event_type, {_uuid_sql(_S, "trip_no")} AS trip_id, {_uuid_sql(_S, "'r'", "trip_no")} AS rider_id,
  CASE WHEN event_type <> 'trip_requested' THEN {_uuid_sql(_S, "'d'", "trip_no")} END AS driver_id, round(pickup_lat, 6) AS pickup_lat, round(pickup_lng, 6) AS pickup_lng,
  round(dropoff_lat, 6) AS dropoff_lat, round(dropoff_lng, 6) AS dropoff_lng, CASE WHEN event_type = 'trip_ended' THEN trip_distance_km END AS trip_distance_km,
  CASE WHEN event_type = 'trip_ended' THEN fare_amount_usd END AS fare_amount_usd FROM k"""


def _noise_sql(kind: str, most: float) -> str:
    return _between_sql(-most, most, _S, "trip_no", "i", f"'{kind}'")


PINGS_SQL = f"""WITH {_TRIPS},
c AS (SELECT *, dropoff_us - pickup_us AS span, least({S.MOST_PINGS}, greatest(1, (dropoff_us - pickup_us) // {int(EVERY * 1e6)})) AS n FROM g),
p AS (SELECT *, i / n::DOUBLE AS f FROM (SELECT *, unnest(range(0, n)) AS i FROM c))
SELECT {_uuid_sql(_S, "trip_no", "'ping'", "i")} AS event_id, pickup_us + i * {int(EVERY * 1e6)} AS event_us, {_uuid_sql(_S, "trip_no")} AS trip_id, {_uuid_sql(_S, "'d'", "trip_no")} AS driver_id,
  round(pickup_lat + (dropoff_lat - pickup_lat) * f + {_noise_sql("y", S.DEGREE_NOISE)}, 6) AS lat, round(pickup_lng + (dropoff_lng - pickup_lng) * f + {_noise_sql("x", S.DEGREE_NOISE)}, 6) AS lng,
  round(greatest(0, CASE WHEN span > 0 THEN trip_distance_km / (span / 3.6e9::DOUBLE) ELSE 0 END + {_noise_sql("v", S.SPEED_NOISE)}), 2) AS speed_kmh,
  round({_bearing_sql("pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng")}, 2) AS heading_deg,
  round({_between_sql(3.0, 12.0, _S, "trip_no", "i", "'m'")}, 2) AS accuracy_m FROM p"""

RECORDS_SQL = f"""WITH {B.SQL}, r AS (SELECT *, CASE WHEN n % 3 = 0 THEN 'gps_ping' ELSE event_type END AS kind FROM ev)
SELECT CASE WHEN kind = 'gps_ping' THEN '{S.GPS_TOPIC}' ELSE '{S.TRIPS_TOPIC}' END AS topic, trip_id AS "key", event_id, kind AS event_type, us AS event_us FROM r"""

_JITTER = _point_sql("zone", _S, "event_id")
JITTER_SQL = f"""WITH {B.SQL}, z AS (SELECT event_id, {_ZONE} AS zone FROM ev)
SELECT event_id, zone, round({_JITTER[0]}, 6) AS lat, round({_JITTER[1]}, 6) AS lng FROM z WHERE zone IS NOT NULL"""

MEMORY_SQL = """SELECT i AS trip_no, epoch_us(TIMESTAMP '2024-01-01 08:00:00') + i * 60000000 AS pickup_us, epoch_us(TIMESTAMP '2024-01-01 09:00:00') + i * 60000000 AS dropoff_us,
  40.7::DOUBLE AS pickup_lat, (-74.0)::DOUBLE AS pickup_lng, 40.8::DOUBLE AS dropoff_lat, (-73.9)::DOUBLE AS dropoff_lng, i::DOUBLE AS trip_distance_km, 2.0::DOUBLE * i AS fare_amount_usd
FROM range(0, 5) t(i)"""

QUERIES = {
    "hire_trips": (hire_trips, HIRE_SQL),
    "generated_lifecycle": (generated_lifecycle, LIFECYCLE_SQL),
    "generated_pings": (generated_pings, PINGS_SQL),
    "log_records": (log_records, RECORDS_SQL),
    "quarantine": (quarantine, f"WITH {B.SQL} SELECT event_id, us AS event_us, event_type, trip_id FROM lc JOIN (SELECT n, event_id FROM ev) USING (n) WHERE driver_id IS NULL"),
    "typed_events": (typed_events, f"WITH {B.SQL} SELECT event_id, event_type, 'log' AS source_system FROM ev WHERE event_type IN ('trip_started', 'trip_ended')"),
    "bearings": (bearings, f"WITH {B.SQL} SELECT event_id, round({_bearing_sql('40.758::DOUBLE', '(-73.9855)::DOUBLE', 'lat', 'lng')}, 6) AS heading_deg FROM ev"),
    "jittered_points": (jittered_points, JITTER_SQL),
    "memory_trips": (memory_trips, MEMORY_SQL),
    "top_zones": (top_zones, f"WITH {B.SQL} SELECT {_ZONE} AS zone, count(*) AS pings FROM pg WHERE {_ZONE} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
}
