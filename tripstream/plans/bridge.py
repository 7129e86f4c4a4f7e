
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 1704067200000000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    df = raw.withColumn("us", F.lit(BASE) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {BASE}) div 60")).withColumn("micros", micros)
    kind = F.create_map(*[F.lit(x) for p in (("signup", "trip_requested"), ("view", "trip_accepted"), ("click", "trip_started"), ("purchase", "trip_ended"), ("error", "trip_cancelled")) for x in p])
    return df.select(
        F.col("event_id").alias("n"), F.col("event_id").cast("string").alias("event_id"), F.timestamp_micros("us").alias("event_ts"), kind[F.col("event_type")].alias("event_type"),
        F.expr(f"concat('T', user_id, '-', (us - {BASE}) div 3600000000)").alias("trip_id"), F.expr("concat('R', user_id)").alias("rider_id"), F.expr("concat('D', user_id % 20)").alias("driver_id"),
        F.expr("40.44D + (event_id * 7919 % 5200) / 10000D").alias("lat"), F.expr("-74.31D + (event_id * 104729 % 6700) / 10000D").alias("lng"),
        F.expr("case when event_id % 11 = 0 then null else value end").alias("speed_kmh"), F.lit(None).cast("double").alias("heading_deg"),
        F.expr("cast(event_id * 37 % 600 as double)").alias("accuracy_m"), F.lit(None).cast("timestamp").alias("ingest_ts"), "props",
    )


def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        "n", "event_id", "event_ts", "event_type", "trip_id", "rider_id", F.when(F.col("event_type") != "trip_requested", F.col("driver_id")).alias("driver_id"),
        F.col("lat").alias("pickup_lat"), F.col("lng").alias("pickup_lng"), (F.col("lat") + 0.01).alias("dropoff_lat"), (F.col("lng") + 0.01).alias("dropoff_lng"),
        F.col("accuracy_m").alias("trip_distance_km"), (F.col("accuracy_m") * 2).alias("fare_amount_usd"), F.when(F.col("event_type") == "trip_cancelled", "rider").alias("cancelled_by"),
    )


SQL = f"""
ev AS (SELECT event_id AS n, event_id::VARCHAR AS event_id, {BASE} + (epoch_us(ts) - {BASE}) // 60 AS us,
  CASE event_type WHEN 'signup' THEN 'trip_requested' WHEN 'view' THEN 'trip_accepted' WHEN 'click' THEN 'trip_started' WHEN 'purchase' THEN 'trip_ended' WHEN 'error' THEN 'trip_cancelled' END AS event_type,
  'T' || user_id || '-' || (({BASE} + (epoch_us(ts) - {BASE}) // 60 - {BASE}) // 3600000000) AS trip_id, 'R' || user_id AS rider_id, 'D' || (user_id % 20) AS driver_id,
  40.44::DOUBLE + (event_id * 7919 % 5200)::DOUBLE / 10000 AS lat, -74.31::DOUBLE + (event_id * 104729 % 6700)::DOUBLE / 10000 AS lng,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS speed_kmh, (event_id * 37 % 600)::DOUBLE AS accuracy_m, props FROM events),
pg AS (SELECT * FROM ev WHERE lat BETWEEN 40.45 AND 40.95 AND lng BETWEEN -74.30 AND -73.65 AND (speed_kmh IS NULL OR speed_kmh BETWEEN 0 AND 200) AND accuracy_m BETWEEN 0 AND 500),
lc AS (SELECT n, us, event_type, trip_id, rider_id, CASE WHEN event_type <> 'trip_requested' THEN driver_id END AS driver_id, lat AS pickup_lat, lng AS pickup_lng, lat + 0.01::DOUBLE AS dropoff_lat,
  lng + 0.01::DOUBLE AS dropoff_lng, accuracy_m AS trip_distance_km, accuracy_m * 2 AS fare_amount_usd, CASE WHEN event_type = 'trip_cancelled' THEN 'rider' END AS cancelled_by FROM ev)"""

STATUS = "CASE WHEN cancelled_us IS NOT NULL THEN 'CANCELLED' WHEN ended_us IS NOT NULL THEN 'COMPLETED' WHEN started_us IS NOT NULL THEN 'IN_PROGRESS' WHEN accepted_us IS NOT NULL THEN 'ACCEPTED' ELSE 'PENDING' END"
_AT = ", ".join(f"max(us) FILTER (event_type = 'trip_{k}') AS {k}_us" for k in ("requested", "accepted", "started", "ended", "cancelled"))
_GEO = ", ".join(f"max({c}) FILTER (event_type = 'trip_requested') AS {c}" for c in ("pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng"))


def fold_sql(source: str) -> str:
    return (
        f"SELECT *, {STATUS} AS status FROM (SELECT trip_id, max(rider_id) AS rider_id, max(driver_id) AS driver_id, {_AT}, {_GEO}, max(trip_distance_km) FILTER (event_type = 'trip_ended') AS trip_distance_km, "
        f"max(fare_amount_usd) FILTER (event_type = 'trip_ended') AS fare_amount_usd, max(cancelled_by) FILTER (event_type = 'trip_cancelled') AS cancelled_by, min(us) AS first_event_us, max(us) AS last_event_us "
        f"FROM {source} GROUP BY trip_id)"
    )


MATCHED_SQL = f"""{SQL},
tf AS ({fold_sql("lc")}),
mt AS (SELECT g.event_id, g.us, g.trip_id, g.driver_id, g.lat, g.lng, t.rider_id, t.status AS trip_status FROM pg g JOIN tf t ON g.trip_id = t.trip_id
  WHERE t.started_us IS NOT NULL AND t.cancelled_us IS NULL AND g.us >= t.started_us - 30000000 AND g.us <= coalesce(t.ended_us, t.last_event_us) + 300000000)"""


def zone_sql(lat: str = "lat", lng: str = "lng") -> str:
    from math import cos, radians

    from tripstream import settings as S

    east = S.KM_PER_DEGREE * cos(radians(S.MID_LATITUDE))
    d = {n: f"(({lat} - {a}::DOUBLE) * 111.0::DOUBLE) * (({lat} - {a}::DOUBLE) * 111.0::DOUBLE) + (({lng} - ({b})::DOUBLE) * {east!r}::DOUBLE) * (({lng} - ({b})::DOUBLE) * {east!r}::DOUBLE)" for n, (a, b) in S.ZONES.items()}
    low = f"least({', '.join(d.values())})"
    cases = " ".join(f"WHEN {x} = {low} THEN '{n}'" for n, x in reversed(d.items()))
    return f"CASE WHEN {lat} BETWEEN 40.45 AND 40.95 AND {lng} BETWEEN -74.30 AND -73.65 THEN CASE {cases} END END"


def hex_sql(lat: str = "lat", lng: str = "lng") -> str:
    """As a chain of subselect columns q, r over (lat, lng); returns an expression over qf and rf."""
    from math import cos, radians, sqrt

    from tripstream import settings as S

    x = f"(({lng} + 74.0::DOUBLE) * {S.KM_PER_DEGREE * cos(radians(S.MID_LATITUDE))!r}::DOUBLE)"
    y = f"(({lat} - {S.MID_LATITUDE}::DOUBLE) * 111.0::DOUBLE)"
    q, r = f"(({x} * {sqrt(3) / 3!r}::DOUBLE - {y} / 3) / {S.HEX_EDGE_KM}::DOUBLE)", f"(({y} * {2 / 3!r}::DOUBLE) / {S.HEX_EDGE_KM}::DOUBLE)"
    cq, cr, cs = f"floor({q} + 0.5)::BIGINT", f"floor({r} + 0.5)::BIGINT", f"floor(-{q} - {r} + 0.5)::BIGINT"
    dq, dr, ds = f"abs({cq} - {q})", f"abs({cr} - {r})", f"abs({cs} + {q} + {r})"
    first = f"({dq} > {dr} AND {dq} > {ds})"
    return f"(CASE WHEN {first} THEN -{cr} - {cs} ELSE {cq} END)::VARCHAR || ':' || (CASE WHEN {first} THEN {cr} WHEN {dr} > {ds} THEN -{cq} - {cs} ELSE {cr} END)::VARCHAR"


HAVERSINE_SQL = (
    "2 * 6371.0088::DOUBLE * asin(sqrt(least(pow(sin(radians(lat - prev_lat) / 2), 2) + cos(radians(prev_lat)) * cos(radians(lat)) * pow(sin(radians(lng - prev_lng) / 2), 2), 1.0::DOUBLE)))"
)
