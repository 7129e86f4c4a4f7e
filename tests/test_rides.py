"""Shapes and marts against hand-made rows, streams against batch."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tripstream.functions import expressions as X
from tripstream.operators import marts, shapes
from tripstream.streaming import jobs
from tripstream.streaming.snapshot import SnapshotTable

T0 = datetime(2024, 1, 15, 8)
PING = shapes.PING + ", ingest_ts timestamp"
MATCHED = "event_id string, event_ts timestamp, trip_id string, driver_id string, lat double, lng double, trip_status string"


def at(**k):
    return T0 + timedelta(**k)


def ping(spark, *rows):
    full = [(i, t, "gps_ping", trip, "d1", lat, lng, v, 90.0, acc, T0) for i, t, trip, lat, lng, v, acc in rows]
    return spark.createDataFrame(full, PING)


def events(spark, *rows):
    return spark.createDataFrame([(f"e{i}", t, k, trip, "r1", d, 40.75, -73.98, 40.68, -73.94, 6.5, 22.0, by) for i, (k, t, trip, d, by) in enumerate(rows)], shapes.LIFECYCLE)


def test_ping_quality_and_dedup(spark):
    nan = float("nan")
    df = ping(
        spark, ("a", T0, "T", 40.75, -73.98, 45.0, 5.0), ("a", T0, "T", 40.75, -73.98, 45.0, 5.0), ("b", T0, "T", 37.77, -122.42, 1.0, 5.0),
        ("c", T0, "T", 40.75, -73.98, 900.0, 5.0), ("d", T0, "T", 40.75, -73.98, None, None), ("e", T0, "T", 40.75, -73.98, 1.0, 5000.0),
        ("f", T0, "T", nan, -73.98, 1.0, 5.0), ("g", T0, "T", 40.45, -74.30, 200.0, 500.0), ("h", T0, "T", 40.75, -73.98, nan, 5.0), ("i", T0, "T", None, -73.98, 1.0, 5.0),
    )
    assert sorted(r.event_id for r in shapes.clean_pings(df).collect()) == ["a", "d", "g"]


def test_fold_and_status(spark):
    df = events(
        spark, ("trip_requested", T0, "A", None, None), ("trip_accepted", at(seconds=30), "A", "d1", None), ("trip_started", at(minutes=2), "A", "d1", None),
        ("trip_ended", at(minutes=15), "A", "d1", None), ("trip_requested", T0, "B", None, None), ("trip_started", T0, "C", "d", None),
        ("trip_cancelled", at(minutes=1), "C", None, "rider"), ("trip_requested", T0, "D", None, None), ("trip_accepted", T0, "D", "d", None),
    )
    got = {r.trip_id: r for r in shapes.fold_trips(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"A": "COMPLETED", "B": "PENDING", "C": "CANCELLED", "D": "ACCEPTED"}
    assert (got["A"].first_event_ts, got["A"].last_event_ts, got["A"].trip_distance_km) == (T0, at(minutes=15), 6.5)
    assert got["B"].trip_distance_km is None and got["C"].cancelled_by == "rider"


def test_merge_keeps_known_and_widens(spark):
    old = shapes.fold_trips(events(spark, ("trip_requested", T0, "A", None, None), ("trip_started", at(minutes=2), "A", "d1", None)))
    new = shapes.fold_trips(events(spark, ("trip_started", at(minutes=1), "A", "d2", None), ("trip_ended", at(minutes=9), "A", "d2", None), ("trip_requested", T0, "B", None, None)))
    got = {r.trip_id: r for r in shapes.merge_trips(old, new).collect()}
    assert got["A"].started_ts == at(minutes=2) and got["A"].driver_id == "d2" and got["A"].status == "COMPLETED" and got["B"].status == "PENDING"


@pytest.mark.parametrize("minutes, hits", [(5, 1), (-5, 0), (-1 / 6, 1), (18, 1), (45, 0), (20, 1)])
def test_match_bounds(spark, minutes, hits):
    trips = shapes.fold_trips(events(spark, ("trip_started", T0, "T", "d1", None), ("trip_ended", at(minutes=15), "T", "d1", None)))
    assert shapes.match_pings(ping(spark, ("a", at(minutes=minutes), "T", 40.75, -73.98, 1.0, 1.0)), trips).count() == hits


def test_match_leaves_cancelled_trips(spark):
    trips = shapes.fold_trips(events(spark, ("trip_started", T0, "T", "d1", None), ("trip_cancelled", at(minutes=5), "T", "d1", "rider")))
    assert shapes.match_pings(ping(spark, ("a", at(minutes=1), "T", 40.75, -73.98, 1.0, 1.0)), trips).count() == 0


def test_marts(spark):
    rows = [(f"e{i}", at(seconds=i), t, d, 40.7831, -73.9712, s) for i, (t, d, s) in enumerate([("A", "1", "IN_PROGRESS"), ("A", "1", "IN_PROGRESS"), ("B", "2", "COMPLETED"), ("C", "1", "IN_PROGRESS")])]
    m = spark.createDataFrame([*rows, rows[0]], MATCHED)
    active = marts.active_trips(m).collect()
    assert [(r.borough, r.active_trips) for r in active] == [("Manhattan", 2)]
    d = marts.surge(marts.demand(m)).collect()
    assert [(r.ping_count, r.distinct_trips, r.distinct_drivers, r.surge) for r in d] == [(4, 3, 2, 1.5)]
    assert [(r.driver_id, r.concurrent_trip_count, r.sample_trip_ids) for r in marts.dual_trips(m).collect()] == [("1", 2, ["A", "C"])]
    assert marts.rolled_up(marts.sketches(m)).collect()[0].distinct_trips == 3
    assert marts.demand_hex(m).collect()[0].ping_count == 4
    once = m.dropDuplicates(["event_id"])
    for mart in (marts.demand, marts.demand_hex):
        assert mart(once, unique_pings=True).collect() == mart(m).collect()


def test_teleport(spark):
    near, far = (40.7580, -73.9855), (40.6413, -73.7781)
    rows = [("a", T0, "T", "1", *near, "x"), ("b", at(seconds=60), "T", "1", *far, "x"), ("c", at(seconds=30), "T", "2", *near, "x"), ("d", at(seconds=30.5), "T", "2", *far, "x")]
    got = marts.teleports(spark.createDataFrame(rows, MATCHED)).collect()
    assert [(r.event_id, r.prev_event_id) for r in got] == [("b", "a")] and 20 < got[0].distance_km < 30


def test_teleport_over_days(spark, monkeypatch):
    """The ping before is the driver's last on any earlier day; no driver and no time are values like any other."""
    rng = random.Random(4)
    spots = [(40.7580, -73.9855), (40.6413, -73.7781), (40.75, -73.98)]
    rows = [
        (f"e{i:03}", at(minutes=rng.choice((1, 9, 30, 1430)) + 720 * rng.randrange(8)) if i % 19 else None, "T", rng.choice(("1", "2", None)), *rng.choice(spots), "x")
        for i in range(300)
    ]
    want = set()
    for driver in ("1", "2", None):
        own = sorted((r for r in rows if r[3] == driver and r[1]), key=lambda r: (r[1], r[0]))
        want |= {(b[0], a[0]) for a, b in zip(own, own[1:], strict=False) if (b[1] - a[1]).total_seconds() >= 1}
    monkeypatch.setattr(marts, "flagged", lambda df: df)
    pairs = marts.teleports(spark.createDataFrame(rows, MATCHED)).collect()
    got = {(r.event_id, r.prev_event_id) for r in pairs if r.event_ts and r.prev_event_ts and (r.event_ts - r.prev_event_ts).total_seconds() >= 1}
    assert got == want and len({r[1].date() for r in rows if r[1]}) > 3


def test_zone_and_prefix(spark):
    df = spark.createDataFrame([(40.78, -73.97), (40.64, -73.95), (37.77, -122.4), (None, 1.0)], "lat double, lng double")
    assert [r[0] for r in df.select(X.zone_of()).collect()] == ["Manhattan", "Brooklyn", None, None]
    one = spark.createDataFrame([(datetime(2026, 10, 1, 12, 34, 56), "gps_ping")], "t timestamp, k string")
    assert one.select(X.partition_prefix("bronze/rides/", "t", "k")).first()[0] == "bronze/rides/event_type=gps_ping/year=2026/month=10/day=01/hour=12/"


def test_broken_json_keeps_its_row(spark):
    raw = spark.createDataFrame([(b"k", b"{not json", "t", 0, 1, T0)], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    df = shapes.parse_records(raw, shapes.PING)
    assert df.count() == 1 and shapes.quarantined(df)[1].count() == 1 and df.first().raw_json == "{not json"


def test_snapshot_upserts_once(spark, tmp_path):
    batch = shapes.fold_trips(events(spark, ("trip_requested", T0, "A", None, None)))
    t = SnapshotTable(spark, f"file://{tmp_path}/facts", batch.schema, "trip_id")
    assert t.upsert(batch, 0, shapes.merge_trips) and not t.upsert(batch, 0, shapes.merge_trips)
    assert t.upsert(shapes.fold_trips(events(spark, ("trip_requested", T0, "B", None, None))), 1, shapes.merge_trips)
    assert t.read().count() == 2 and [r.trip_id for r in t.changes().collect()] == ["B"]


def test_streams_match_batch_on_closed_windows(spark, tmp_path):
    rows = [(f"e{i}", at(minutes=i), f"T{i % 3}", f"d{i % 2}", 40.7831, -73.9712, "IN_PROGRESS") for i in range(60)]
    m = spark.createDataFrame(rows, MATCHED)
    m.repartitionByRange(6, "event_ts").sortWithinPartitions("event_ts").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = marts.exact_distinct_stream(source.withColumn("borough", X.zone_of()), "5 minutes", ["borough"], "trip_id", "distinct_trips")
    q = jobs.append(jobs.Job("demand", str(tmp_path), None), out)
    q.awaitTermination()
    got = {(r.window_start, r.borough, r.distinct_trips) for r in spark.read.parquet(f"{tmp_path}/demand").collect()}
    want = {(r.window_start, r.borough, r.distinct_trips) for r in marts.demand(m).collect()}
    assert got and got <= want
    marts_out = jobs.write_batches(jobs.Job("teleport", str(tmp_path), None), jobs.teleport_stream(source))
    marts_out.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/teleport").count() == 0


def test_rides_need_no_corpus_package():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tripstream"
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "llm" in p.read_text()]
    assert users == []
