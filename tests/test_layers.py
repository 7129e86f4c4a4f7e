"""The generator, sources, the keyed table and the streaming jobs from records to marts."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripstream import __main__ as cli
from tripstream import settings as S
from tripstream.functions import expressions as X
from tripstream.operators import shapes
from tripstream.plans import catalog
from tripstream.sources import generator, readers
from tripstream.streaming import jobs, layers
from tripstream.streaming.metrics import Metrics, latency_counts
from tripstream.streaming.snapshot import SnapshotTable

T0 = datetime(2024, 1, 15, 8)


def at(**k):
    return T0 + timedelta(**k)


def trips(spark, *rows):
    return readers.memory_trips(spark, list(rows))


def test_pings_come_at_fixed_intervals(spark):
    t = trips(spark, (T0, at(seconds=100), 40.7, -74.0, 40.71, -73.99, 3.0, 9.0), (T0, T0, 40.7, -74.0, 40.7, -74.0, 1.0, 9.0), (T0, at(hours=3), 40.7, -74.0, 40.71, -73.99, 3.0, 9.0))
    got = generator.pings(t, 30.0).orderBy("trip_id", "event_ts").collect()
    by = {}
    for r in got:
        by.setdefault(r.trip_id, []).append(r)
    own = {len(rows): rows for rows in by.values()}
    assert sorted(own) == [1, 3, 360] and [r.event_ts for r in own[3]] == [T0, at(seconds=30), at(seconds=60)]
    assert own[1][0].speed_kmh <= S.SPEED_NOISE and all(abs(r.lat - (40.7 + 0.01 * i / 3)) <= 1.01e-4 for i, r in enumerate(own[3]))
    assert all(3 <= r.accuracy_m <= 12 and r.speed_kmh >= 0 for r in got)
    assert generator.pings(t, 1.0).groupBy("trip_id").count().agg(F.max("count")).first()[0] == S.MOST_PINGS
    assert generator.pings(t, 30.0).exceptAll(generator.pings(t, 30.0)).count() == 0
    assert generator.pings(t, 30.0, seed=1).join(generator.pings(t, 30.0, seed=2), "event_id").count() == 0


def test_lifecycle_order_and_ranges(spark):
    t = trips(spark, *[(T0, at(minutes=9), 40.7, -74.0, 40.71, -73.99, 3.0, 9.0)] * 50)
    rows = {}
    for r in generator.lifecycle(t).collect():
        rows.setdefault(r.trip_id, {})[r.event_type] = r
    assert len(rows) == 50 and all(len(r) == 4 for r in rows.values())
    for r in rows.values():
        asked, taken = r["trip_requested"].event_ts, r["trip_accepted"].event_ts
        assert 30 <= (T0 - asked).total_seconds() <= 120.001 and 5 <= (taken - asked).total_seconds() <= 30.001
        assert r["trip_requested"].driver_id is None and r["trip_ended"].fare_amount_usd == 9.0 and r["trip_started"].fare_amount_usd is None
    both = generator.events(t, 60.0)
    assert both.count() == 200 + 450 and both.filter("event_type = 'gps_ping' and rider_id is not null").count() == 0


def test_bearing_and_jitter(spark):
    one = spark.createDataFrame([("Manhattan",), (None,), ("Nowhere",)], "zone string")
    legs = [((40.0, -74.0, 41.0, -74.0), 0.0), ((41.0, -74.0, 40.0, -74.0), 180.0), ((0.0, 0.0, 0.0, 1.0), 90.0), ((40.7831, -73.9712, 40.6413, -73.7781), 133.964)]
    for leg, want in legs:
        assert one.select(X.bearing_deg(*[F.lit(x) for x in leg])).first()[0] == pytest.approx(want, abs=0.1)
    lat, lng = X.jitter_point("zone", F.col("id"))
    points = spark.range(2000).withColumn("zone", F.lit("Manhattan")).select(lat.alias("lat"), lng.alias("lng"))
    center = S.ZONES["Manhattan"]
    away = points.select(X.haversine_km(F.lit(center[0]), F.lit(center[1]), "lat", "lng").alias("km")).collect()
    assert max(r.km for r in away) <= 3.55 and 0.2 < sum(r.km < 1.75 for r in away) / 2000 < 0.3  # a quarter of the area
    lat, lng = X.jitter_point("zone", F.lit(1))
    assert [r[0] is None for r in one.select(lat).collect()] == [False, True, True]


def test_partitions_are_utc_in_any_session(spark):
    frame = spark.createDataFrame([(datetime(2026, 10, 1, 12, 34, 56), "gps_ping"), (datetime(1969, 12, 31, 23, 5), "x")], "t timestamp, k string")
    want = ["b/event_type=gps_ping/year=2026/month=10/day=01/hour=12/", "b/event_type=x/year=1969/month=12/day=31/hour=23/"]
    frame = spark.createDataFrame(frame.select(F.unix_micros("t").alias("us"), "k").collect()).select(F.timestamp_micros("us").alias("t"), "k")
    for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r[0] for r in frame.select(X.partition_prefix("b/", "t", "k")).collect()] == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_event_files_keep_their_rows(spark, tmp_path):
    t = trips(spark, (T0, at(minutes=3), 40.7, -74.0, 40.71, -73.99, 3.0, 9.0))
    sent = generator.lifecycle(t)
    readers.write_event_files(sent, str(tmp_path))
    assert (tmp_path / "event_type=trip_started" / "year=2024" / "month=01" / "day=15" / "hour=08").is_dir()
    got = readers.event_files(spark, str(tmp_path), shapes.LIFECYCLE)
    assert got.select(sorted(sent.columns)).exceptAll(sent.select(sorted(sent.columns))).count() == 0 and got.count() == 4
    some = readers.event_files(spark, str(tmp_path), shapes.LIFECYCLE, ["trip_ended"])
    assert [r.source_system for r in some.collect()] == ["delivery-stream"]
    assert "PartitionFilters: [isnotnull(event_type" in some._jdf.queryExecution().toString().replace("event_type#", "event_type") or "event_type" in some._jdf.queryExecution().toString()
    lines = [json.loads(r.value) for r in readers.json_lines(sent).collect()]
    assert {x["event_type"] for x in lines} == {"trip_requested", "trip_accepted", "trip_started", "trip_ended"} and all("cancelled_by" not in x for x in lines)


def hires(spark, tmp_path):
    rows = [
        (T0, at(minutes=20), 1, 2, 5.0, 20.0), (T0, at(minutes=20), 9, 2, 5.0, 20.0), (at(minutes=1), T0, 1, 2, 5.0, 20.0), (T0, at(hours=5), 1, 2, 5.0, 20.0),
        (T0, at(hours=4), 2, 1, None, None), (at(minutes=3), at(minutes=30), 1, 1, 1.0, -5.0),
    ]
    kinds = "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int, DOLocationID int, trip_miles double, base_passenger_fare double"
    spark.createDataFrame(rows, kinds).withColumn("more", F.lit("x")).write.parquet(f"{tmp_path}/hires")
    (tmp_path / "zones.csv").write_text('"LocationID","Borough","Zone","service_zone"\n1,"Manhattan","a","y"\n2,"Queens","b","y"\n9,"Unknown","c","n"\n')
    return f"{tmp_path}/hires", f"{tmp_path}/zones.csv"


def test_hire_records(spark, tmp_path):
    paths = hires(spark, tmp_path)
    got = sorted(readers.hire_files(spark, *paths).collect(), key=lambda r: (r.pickup_ts, r.dropoff_ts))
    assert [(r.pickup_borough, r.dropoff_borough, r.fare_amount_usd) for r in got] == [("Manhattan", "Queens", 20.0), ("Queens", "Manhattan", 0.0), ("Manhattan", "Manhattan", 0.0)]
    assert got[0].pickup_ts == T0 and got[0].trip_distance_km == pytest.approx(8.04672) and got[1].trip_distance_km == 0
    frame = readers.hire_files(spark, *paths)
    assert [r[0] for r in frame.orderBy("pickup_ts", "dropoff_ts").select(X.zone_of("pickup_lat", "pickup_lng")).collect()][0] is not None
    assert readers.hire_files(spark, *paths, limit=2).count() == 2 and len({r.trip_no for r in got}) == 3


def events(spark, *rows):
    return spark.createDataFrame([(f"e{i}-{trip}", t, k, trip, "r1", d, 40.75, -73.98, 40.68, -73.94, 6.5, 22.0, None) for i, (k, t, trip, d) in enumerate(rows)], shapes.LIFECYCLE)


def test_keyed_table(spark, tmp_path):
    one = shapes.fold_trips(events(spark, *[("trip_requested", at(seconds=i), f"T{i}", None) for i in range(40)]))
    table = SnapshotTable(spark, f"{tmp_path}/t", one.schema, "trip_id", buckets=8)
    table.create()
    assert table.read().count() == 0 and table.version() == (0, -1)
    assert table.upsert(one, 0, shapes.merge_trips) and not table.upsert(one, 0, shapes.merge_trips)
    before = table._last()[1]["buckets"]
    two = shapes.fold_trips(events(spark, ("trip_ended", at(minutes=5), "T3", "d"), ("trip_requested", T0, "N", None)))
    assert table.upsert(two, 1, shapes.merge_trips)
    after = table._last()[1]["buckets"]
    assert 1 <= sum(before.get(b) != f for b, f in after.items()) <= 2  # the others' files are as they were
    assert table.read().count() == 41 and {r.trip_id: r.status for r in table.changes().collect()} == {"T3": "COMPLETED", "N": "PENDING"}
    again = SnapshotTable(spark, f"{tmp_path}/t", one.schema, "trip_id", buckets=8)
    assert again.version() == (2, 1) and not again.upsert(two, 1, shapes.merge_trips)
    with pytest.raises(RuntimeError):
        again._commit(2, {"batch": 9, "buckets": {}})
    seen = again.change_stream(1).writeStream.format("memory").queryName("followed").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    seen.awaitTermination()
    assert spark.table("followed").count() == 42 and spark.table("followed").filter("trip_id = 'T3'").count() == 2
    for i in range(4):
        again.upsert(shapes.fold_trips(events(spark, ("trip_accepted", at(minutes=9 + i), "T3", f"d{i}"))), 2 + i, shapes.merge_trips)
    assert again.vacuum(keep=1) >= 3 and again.read().count() == 41 and again.read().filter("trip_id = 'T3'").first().driver_id == "d3"


def write_rounds(spark, path, rounds):
    for i, df in enumerate(rounds):
        df.coalesce(1).write.mode("append").parquet(path)
        yield i


def test_upserts_survive_replay_and_restart(spark, tmp_path):
    config = layers.LayerConfig(str(tmp_path), None)
    raw = lambda *rows: events(spark, *rows).selectExpr("*", *[f"cast(null as {c.split()[1]}) as {c.split()[0]}" for c in layers.ENVELOPE.split(", ")])
    rounds = [raw(("trip_requested", T0, "A", None), ("trip_requested", T0, None, None)), raw(("trip_started", at(minutes=2), "A", "d1")), raw(("trip_ended", at(minutes=9), "A", "d1"), ("trip_requested", T0, "B", None))]
    want = [{"A": "PENDING"}, {"A": "IN_PROGRESS"}, {"A": "COMPLETED", "B": "PENDING"}]
    for i in write_rounds(spark, config.path("bronze_trips"), rounds):
        layers.silver_trips(spark, config, wait=True)
        assert {r.trip_id: r.status for r in layers.trip_table(spark, config).read().collect()} == want[i]
        layers.silver_trips(spark, config, wait=True)  # nothing new
    table = layers.trip_table(spark, config)
    version = table.version()
    one = shapes.fold_trips(events(spark, ("trip_requested", T0, "Z", None)))
    assert not table.upsert(one, version[1], shapes.merge_trips) and table.version() == version  # the same batch again
    assert spark.read.parquet(config.path("silver_trips_rejected")).count() == 1


def test_stream_drops_duplicates_and_late_pings(spark, tmp_path):
    row = lambda i, t: (i, t, "gps_ping", "T", "d", 40.75, -73.98, 1.0, 1.0, 1.0, T0)
    rounds = [[row("a", T0), row("a", T0), row("b", at(minutes=1))], [row("a", at(seconds=30)), row("c", at(hours=2))], [row("e", at(hours=2, minutes=1))], [row("late", at(minutes=3)), row("d", at(hours=2))]]
    frames = [spark.createDataFrame(r, shapes.PING + ", ingest_ts timestamp") for r in rounds]
    (tmp_path / "in").mkdir()
    source = readers.table_stream(spark, f"{tmp_path}/in", frames[0].schema, 1)
    for _ in write_rounds(spark, f"{tmp_path}/in", frames):
        query = jobs.append(jobs.Job("clean", str(tmp_path), None), shapes.clean_pings(source))
        query.awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/clean").collect())
    assert got == ["a", "b", "c", "d", "e"]


def test_jobs_from_records_to_marts(spark, tmp_path):
    """All layers by the command line; the matched pings and closed windows equal those of the batch functions."""
    paths = hires(spark, tmp_path)
    root, records = f"{tmp_path}/lake", f"{tmp_path}/records"
    assert cli.main(["produce", "--hires", paths[0], "--zones", paths[1], "--record-path", records, "--ping-interval", "20", "--max-trips", "0"]) == 0
    common = ["--warehouse-root", root, "--once", "--metrics", f"{tmp_path}/metrics"]
    with pytest.raises(FileNotFoundError, match="silver gps"):
        cli.main(["silver", "--stream", "matched", *common])
    for topic in ("gps", "trips"):
        assert cli.main(["bronze", "--topic", topic, "--record-path", records, *common]) == 0
    for stream in ("gps", "trips", "matched"):
        assert cli.main(["silver", "--stream", stream, *common]) == 0
    for mart in layers.GOLD:
        assert cli.main(["gold", "--mart", mart, *common]) == 0
    sent = generator.events(readers.hire_files(spark, *paths, seed=0), 20.0, 0)
    read = lambda n: spark.read.parquet(f"{root}/{n}")
    assert read("bronze_gps").count() + read("bronze_trips").count() == sent.count()
    pings = sent.filter("event_type = 'gps_ping'").withColumn("ingest_ts", F.current_timestamp())
    facts = shapes.fold_trips(sent.filter("event_type != 'gps_ping'"))
    want = shapes.match_pings(shapes.clean_pings(pings), facts)
    columns = [c for c in shapes.MATCHED if c != "ingest_ts"]
    got = read("silver_matched")
    assert got.count() == want.count() > 700 and got.select(columns).exceptAll(want.select(columns)).count() == 0
    assert {"silver_processed_ts"} <= set(got.columns) and {"gold_processed_ts", "surge"} <= set(read("gold_demand_5min").columns)
    closed = read("gold_demand_5min")
    assert closed.count() > 20 and closed.filter("distinct_trips < 1 or ping_count < distinct_trips").count() == 0
    assert "flagged_ts" in read("gold_fraud_dual_trip").columns
    text = (tmp_path / "metrics").read_text()
    assert "spark_streaming_processed_rows_total" in text
    layers.silver_gps(spark, layers.LayerConfig(root, None), wait=True)  # a restart finds nothing new
    assert read("silver_gps").count() == shapes.clean_pings(pings).count()


def test_generate_prints_lines(spark, tmp_path, capsys):
    paths = hires(spark, tmp_path)
    assert cli.main(["generate", "--hires", paths[0], "--zones", paths[1], "--max-trips", "1", "--ping-interval", "600"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {x["event_type"] for x in lines} == {"trip_requested", "trip_accepted", "trip_started", "trip_ended", "gps_ping"} and len({x["trip_id"] for x in lines}) == 1
    assert cli.main(["produce", "--hires", paths[0], "--zones", paths[1], "--bootstrap-servers", "nowhere:1"]) == 1


def test_metrics_and_latencies(spark):
    m = Metrics()
    frame = spark.createDataFrame([(T0, at(seconds=s)) for s in (0.5, 2, 20, 4000)], "event_ts timestamp, ingest_ts timestamp")
    m.add_latency(latency_counts(frame))
    m.add_produced(7)
    assert 'le="1.0"} 1' in m.text() and 'le="30.0"} 3' in m.text() and 'le="+Inf"} 4' in m.text() and "rides_events_produced_total 7" in m.text()


def test_catalog(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    m = [("a", "COMPLETED", "d1"), ("b", "COMPLETED", "d2"), ("c", "IN_PROGRESS", "d1"), ("e", "COMPLETED", None)]
    spark.createDataFrame(m, "event_id string, trip_status string, driver_id string").write.parquet(f"{tmp_path}/lake/silver_matched")
    spark.createDataFrame([("d2",)], "driver_id string").write.parquet(f"{tmp_path}/lake/gold_fraud_teleport")
    try:
        catalog.apply(spark, catalog.databases(root) + catalog.tables(root, {"silver": ["matched"], "gold": ["fraud_teleport"]}))
        view = spark.sql(catalog.analyst_views("rides_silver.matched", "rides_gold.fraud_teleport")[1].split(" AS ", 1)[1].replace("rides_gold.rows_safe_for_analysts(m.trip_status, coalesce(f.hit, false))", "m.trip_status = 'COMPLETED' AND NOT coalesce(f.hit, false)"))
        assert sorted(r.event_id for r in view.collect()) == ["a", "e"]
    finally:
        for layer in catalog.LAYERS:
            spark.sql(f"DROP DATABASE IF EXISTS rides_{layer} CASCADE")
    assert any("SELECT ON SCHEMA main.rides_gold TO `analysts`" in g for g in catalog.grants("engineers", "analysts", "main")) and not any("silver" in g and "analysts" in g for g in catalog.grants("engineers", "analysts", "main"))


def test_compact(spark, tmp_path):
    spark.range(1000).repartition(20).write.parquet(f"{tmp_path}/t")
    assert jobs.compact(spark, f"{tmp_path}/t") == 1
    assert spark.read.parquet(f"{tmp_path}/t").count() == 1000 and len(list((tmp_path / "t").glob("*.parquet"))) == 1
