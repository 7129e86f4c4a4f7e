"""The ride queries over the bridge view, and the same in SQL. Times come out as microseconds, rounded doubles as such."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstream.functions.expressions import haversine_km, hex_cell, partition_prefix, valid_ping, zone_of
from tripstream.operators import marts, shapes
from tripstream.streaming import jobs
from tripstream import settings as S
from tripstream.plans import bridge as B
from tripstream.plans import ingest
from tripstream.plans.ingest import micros, rounded

Query = Callable[[SparkSession, str], DataFrame]


def _pings(spark, d):
    return shapes.clean_pings(B.events(spark, d))


def _facts(spark, d):
    return shapes.fold_trips(B.lifecycle(spark, d))


def _matched(spark, d):
    return shapes.match_pings(_pings(spark, d), _facts(spark, d))


def _merge(spark, d):
    e = B.lifecycle(spark, d)
    return micros(shapes.merge_trips(shapes.fold_trips(e.filter("n % 2 = 0")), shapes.fold_trips(e.filter("n % 2 = 1"))))


def _dedup(spark, d):
    e = B.events(spark, d)
    return shapes.clean_pings(e.unionByName(e.filter("n % 7 = 0"))).select("event_id", "trip_id", "driver_id", "lat", "lng")


def _dual(spark, d):
    out = micros(marts.dual_trips(_pings(spark, d)))
    return out.withColumn("sample_trip_ids", F.concat_ws(",", "sample_trip_ids"))


def _haversine(spark, d):
    return B.events(spark, d).select("event_id", F.round(haversine_km(F.lit(40.758), F.lit(-73.9855), "lat", "lng"), 6).alias("km"))


def _zones(spark, d):
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    nation, region = t("nation"), t("region")  # 25 and 5 rows by their definition
    return t("customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


def _explode(spark, d):
    """Positions along each completed trip, one a minute, MOST_PINGS at most."""
    t = _facts(spark, d).filter("status = 'COMPLETED' and started_ts is not null and ended_ts > started_ts")
    n = F.least(F.lit(S.MOST_PINGS), F.greatest(F.lit(1), F.expr("(unix_micros(ended_ts) - unix_micros(started_ts)) div 60000000").cast("int")))
    return t.select("trip_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), F.unix_micros("started_ts").alias("s")).select("trip_id", F.col("i").cast("long").alias("i"), (F.col("s") + F.col("i").cast("long") * 60000000).alias("at_us"))


def _prefix(spark, d):
    e = B.events(spark, d)
    return e.select("event_id", partition_prefix("bronze/rides/", "event_ts", "event_type").alias("prefix"))


def _parsed(spark, d):
    """Through records of a log and back; `props` alone is kept."""
    e = B.events(spark, d).select(F.to_json(F.struct("event_id", "props")).cast("binary").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("n").alias("offset"), F.col("event_ts").alias("timestamp"), F.col("trip_id").cast("binary").alias("key"))
    p = shapes.parse_records(e, "event_id string, props string")
    return p.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "kafka_key", "kafka_offset")


def _near(estimates: DataFrame, exact: DataFrame, error: float) -> DataFrame:
    """Exact counts per window and zone, and whether the estimate is within three standard errors (or two trips) of it."""
    both = micros(estimates).withColumnRenamed("trips", "estimate").join(micros(exact), ["window_start_us", "window_end_us", "borough"], "full_outer")
    near = F.abs(F.col("estimate") - F.col("trips")) <= F.greatest(F.lit(2.0), 3 * error * F.col("trips"))
    return both.select("window_start_us", "window_end_us", "borough", "trips", F.coalesce(near, F.lit(False)).alias("near"))


def _zoned(spark, d):
    return _pings(spark, d).withColumn("borough", zone_of()).filter("borough is not null")


def _rollup(spark, d):
    df = _pings(spark, d).withColumn("cell", hex_cell()).withColumn("borough", zone_of()).filter("cell is not null")
    sketch = marts.rolled_up(marts.sketches(_pings(spark, d))).withColumnRenamed("distinct_trips", "trips")
    return _near(sketch, marts.windowed(df, "5 minutes", ["borough"], {"trips": F.count_distinct("trip_id")}), 0.0163)


def _approx(spark, d):
    df = _zoned(spark, d)
    return _near(*[marts.windowed(df, "5 minutes", ["borough"], {"trips": f("trip_id")}) for f in (F.approx_count_distinct, F.count_distinct)], 0.05)


def _open_ended(spark, d):
    out = shapes.match_pings(_pings(spark, d), _facts(spark, d), open_ended=True)
    return micros(out.select("event_id", "event_ts", "trip_id", "trip_status"))


def _analyst(spark, d):
    flagged = marts.teleports(_pings(spark, d)).filter("driver_id like 'D1%'")  # in these tables every driver leaps somewhere
    return jobs.analyst_view(_matched(spark, d), flagged).select("event_id", "trip_id", "driver_id")


_W = "us - us % 300000000 AS window_start_us, us - us % 300000000 + 300000000 AS window_end_us"
_M = "us - us % 60000000 AS window_start_us, us - us % 60000000 + 60000000 AS window_end_us"
_DEMAND = "count(DISTINCT event_id) AS ping_count, count(DISTINCT trip_id) AS distinct_trips, count(DISTINCT driver_id) AS distinct_drivers"
_Z, _H = B.zone_sql(), B.hex_sql()
_TELEPORT = f"""WITH {B.SQL}, l AS (SELECT event_id, us, driver_id, trip_id, lat, lng, lag(event_id) OVER w AS prev_event_id, lag(us) OVER w AS prev_us, lag(trip_id) OVER w AS prev_trip_id, lag(lat) OVER w AS prev_lat, lag(lng) OVER w AS prev_lng
  FROM pg WINDOW w AS (PARTITION BY driver_id ORDER BY us, event_id)),
x AS (SELECT *, {B.HAVERSINE_SQL} AS km, (us - prev_us) / 1e6::DOUBLE AS sec FROM l WHERE prev_event_id IS NOT NULL),
y AS (SELECT *, CASE WHEN sec > 0 THEN km / sec * 3600 ELSE 0 END AS kmh FROM x)
SELECT event_id, us AS event_us, driver_id, trip_id, prev_event_id, prev_us AS prev_event_us, prev_trip_id, round(prev_lat, 6) AS prev_lat, round(prev_lng, 6) AS prev_lng, round(lat, 6) AS lat, round(lng, 6) AS lng,
  round(km, 6) AS distance_km, round(sec, 6) AS time_delta_seconds, round(kmh, 6) AS implied_speed_kmh FROM y WHERE kmh > 200 AND sec >= 1 AND km >= 0.5"""
_DEMAND_SQL = f"SELECT {_W}, {_Z} AS borough, {_DEMAND} FROM mt WHERE {_Z} IS NOT NULL GROUP BY 1, 2, 3"
_older = ", ".join(f"coalesce(k.{c}, n.{c}) AS {c}" for c in ("requested_us", "accepted_us", "started_us", "ended_us", "cancelled_us", "pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng", "trip_distance_km", "fare_amount_usd", "cancelled_by"))


def _all() -> dict[str, tuple[Query, str | None]]:
    m = B.MATCHED_SQL
    return {
        "quality_filter": (lambda s, d: B.events(s, d).filter(valid_ping()).select("event_id", "lat", "lng", "speed_kmh", "accuracy_m"), f"WITH {B.SQL} SELECT event_id, lat, lng, speed_kmh, accuracy_m FROM pg"),
        "gps_dedup": (_dedup, f"WITH {B.SQL} SELECT event_id, trip_id, driver_id, lat, lng FROM pg"),
        "trip_facts": (lambda s, d: micros(_facts(s, d)), f"WITH {B.SQL} {B.fold_sql('lc')}"),
        "trip_facts_merge": (_merge, f"WITH {B.SQL}, k AS ({B.fold_sql('(SELECT * FROM lc WHERE n % 2 = 0)')}), n AS ({B.fold_sql('(SELECT * FROM lc WHERE n % 2 = 1)')}), "
            f"m AS (SELECT coalesce(k.trip_id, n.trip_id) AS trip_id, CASE WHEN k.trip_id IS NOT NULL THEN k.rider_id ELSE n.rider_id END AS rider_id, coalesce(n.driver_id, k.driver_id) AS driver_id, {_older}, "
            f"least(k.first_event_us, n.first_event_us) AS first_event_us, greatest(k.last_event_us, n.last_event_us) AS last_event_us FROM k FULL JOIN n ON k.trip_id = n.trip_id) SELECT *, {B.STATUS} AS status FROM m"),
        "gps_matched": (lambda s, d: micros(_matched(s, d).select("event_id", "event_ts", "trip_id", "driver_id", "lat", "lng", "rider_id", "trip_status")),
            f"WITH {m} SELECT event_id, us AS event_us, trip_id, driver_id, lat, lng, rider_id, trip_status FROM mt"),
        "active_trips_1min": (lambda s, d: micros(marts.active_trips(_matched(s, d))),
            f"WITH {m} SELECT {_M}, {_Z} AS borough, count(DISTINCT trip_id)::INT AS active_trips FROM mt WHERE trip_status = 'IN_PROGRESS' AND {_Z} IS NOT NULL GROUP BY 1, 2, 3"),
        "demand_5min": (lambda s, d: micros(marts.demand(_matched(s, d), unique_pings=True)), f"WITH {m} {_DEMAND_SQL}"),
        "surge_ratio": (lambda s, d: rounded(micros(marts.surge(marts.demand(_matched(s, d), unique_pings=True)))), f"WITH {m} SELECT *, round(distinct_trips / greatest(distinct_drivers, 1)::DOUBLE, 6) AS surge FROM ({_DEMAND_SQL})"),
        "active_trips_hex": (lambda s, d: micros(marts.active_trips_hex(_matched(s, d))),
            f"WITH {m} SELECT {_M}, {_H} AS cell, {_Z} AS borough, count(DISTINCT trip_id)::INT AS active_trips FROM mt WHERE trip_status = 'IN_PROGRESS' GROUP BY 1, 2, 3, 4"),
        "demand_hex": (lambda s, d: micros(marts.demand_hex(_matched(s, d), unique_pings=True)), f"WITH {m} SELECT {_W}, {_H} AS cell, {_Z} AS borough, {_DEMAND} FROM mt GROUP BY 1, 2, 3, 4"),
        "hex_cells": (lambda s, d: B.events(s, d).select("event_id", hex_cell().alias("cell")), f"WITH {B.SQL} SELECT event_id, {_H} AS cell FROM ev"),
        "fraud_teleport": (lambda s, d: rounded(micros(marts.teleports(_pings(s, d)))), _TELEPORT),
        "fraud_dual_trip": (_dual, f"WITH {B.SQL}, t AS (SELECT {_W}, driver_id, list_sort(list(DISTINCT trip_id)) AS x FROM pg GROUP BY 1, 2, 3) "
            "SELECT window_start_us, window_end_us, driver_id, len(x)::INT AS concurrent_trip_count, array_to_string(x[1:5], ',') AS sample_trip_ids FROM t WHERE len(x) > 1"),
        "borough_attribution": (lambda s, d: B.events(s, d).select("event_id", zone_of().alias("borough")), f"WITH {B.SQL} SELECT event_id, {_Z} AS borough FROM ev"),
        "haversine": (_haversine, f"WITH {B.SQL} SELECT event_id, round({B.HAVERSINE_SQL}, 6) AS km FROM (SELECT *, 40.758::DOUBLE AS prev_lat, -73.9855::DOUBLE AS prev_lng FROM ev)"),
        "json_parse": (_parsed, f"WITH {B.SQL} SELECT event_id, (props->>'$.k')::BIGINT AS k, trip_id AS kafka_key, n AS kafka_offset FROM ev"),
        "trip_explode": (_explode, f"WITH {m}, x AS (SELECT trip_id, started_us, least(3600, greatest(1, (ended_us - started_us) // 60000000)) AS n FROM tf WHERE status = 'COMPLETED' AND started_us IS NOT NULL AND ended_us > started_us) "
            "SELECT trip_id, i, started_us + i * 60000000 AS at_us FROM (SELECT *, unnest(range(0, n)) AS i FROM x)"),
        "zone_lookup": (_zones, "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
        "partition_prefix": (_prefix, f"WITH {B.SQL} SELECT event_id, 'bronze/rides/event_type=' || event_type || strftime(make_timestamp(us), '/year=%Y/month=%m/day=%d/hour=%H/') AS prefix FROM ev"),
        "top_drivers": (lambda s, d: marts.top(_pings(s, d).groupBy("driver_id").agg(F.count("*").alias("pings")), "pings", 10, "driver_id"),
            f"WITH {B.SQL} SELECT driver_id, count(*) AS pings FROM pg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "top_cells": (lambda s, d: marts.top(_pings(s, d).groupBy(hex_cell().alias("cell")).agg(F.count("*").alias("pings")), "pings", 10, "cell"),
            f"WITH {B.SQL} SELECT {_H} AS cell, count(*) AS pings FROM pg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
        "demand_approx": (_approx, f"WITH {B.SQL} SELECT {_W}, {_Z} AS borough, count(DISTINCT trip_id) AS trips, true AS near FROM pg WHERE {_Z} IS NOT NULL GROUP BY 1, 2, 3"),
        "demand_sketch_rollup": (_rollup, f"WITH {B.SQL} SELECT {_W}, {_Z} AS borough, count(DISTINCT trip_id) AS trips, true AS near FROM pg GROUP BY 1, 2, 3"),
        "gps_dedup_first": (
            lambda s, d: shapes.clean_pings(B.events(s, d).unionByName(B.events(s, d).filter("n % 5 = 0")), dedup_first=True).select("event_id", "lat", "lng"),
            f"WITH {B.SQL} SELECT event_id, lat, lng FROM pg",
        ),
        "gps_matched_open": (
            _open_ended,
            f"WITH {m} SELECT g.event_id, g.us AS event_us, g.trip_id, t.status AS trip_status FROM pg g JOIN tf t ON g.trip_id = t.trip_id WHERE t.started_us IS NOT NULL AND t.cancelled_us IS NULL "
            "AND g.us >= t.started_us - 30000000 AND (t.ended_us IS NULL OR g.us <= t.ended_us + 300000000)",
        ),
        "surge_hex": (
            lambda s, d: rounded(micros(marts.surge(marts.demand_hex(_matched(s, d), unique_pings=True)))),
            f"WITH {m} SELECT *, round(distinct_trips / greatest(distinct_drivers, 1)::DOUBLE, 6) AS surge FROM (SELECT {_W}, {_H} AS cell, {_Z} AS borough, {_DEMAND} FROM mt GROUP BY 1, 2, 3, 4)",
        ),
        "analyst_pings": (
            _analyst,
            f"WITH {m}, fl AS ({_TELEPORT.replace('WITH ' + B.SQL + ', l AS', 'WITH l AS')}) SELECT event_id, trip_id, driver_id FROM mt WHERE trip_status = 'COMPLETED' AND driver_id NOT IN (SELECT driver_id FROM fl WHERE driver_id LIKE 'D1%')",
        ),
        **ingest.QUERIES,
    }


def queries() -> dict[str, Query]:
    return {n: q for n, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _all().items() if s}
