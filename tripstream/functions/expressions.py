"""Column builders: quality predicates, zones, distances, hex cells, trip status. All stay in the JVM."""

from __future__ import annotations

from functools import reduce
from math import cos, pi, radians, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripstream import settings as S


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def valid_coordinates(lat="lat", lng="lng") -> Column:
    lat, lng = _col(lat), _col(lng)
    inside = lat.between(S.BBOX[0], S.BBOX[2]) & lng.between(S.BBOX[1], S.BBOX[3])
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & inside, F.lit(False))


def _absent_or_within(c, most: float) -> Column:
    c = _col(c)
    return c.isNull() | (~F.isnan(c) & c.between(0.0, most))


def plausible_speed(c="speed_kmh") -> Column:
    return _absent_or_within(c, S.MAX_SPEED_KMH)


def usable_accuracy(c="accuracy_m") -> Column:
    return _absent_or_within(c, S.MAX_ACCURACY_M)


def valid_ping() -> Column:
    return valid_coordinates() & plausible_speed() & usable_accuracy()


def zone_of(lat="lat", lng="lng") -> Column:
    """The nearest centroid's zone; null outside the box or without coordinates; of equally near ones the last."""
    lat, lng = _col(lat), _col(lng)
    east = S.KM_PER_DEGREE * cos(radians(S.MID_LATITUDE))
    away = [(n, ((lat - a) * S.KM_PER_DEGREE) * ((lat - a) * S.KM_PER_DEGREE) + ((lng - b) * east) * ((lng - b) * east)) for n, (a, b) in S.ZONES.items()]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, d) in enumerate(away)]))
    return F.when(valid_coordinates(lat, lng), best["n"])


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = map(_col, (lat1, lng1, lat2, lng2))
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lng2 - lng1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return 2 * S.EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def hex_cell(lat="lat", lng="lng", edge_km: float = S.HEX_EDGE_KM) -> Column:
    """A cell q:r of a pointy-top hexagonal grid on a flat map around the zones; null without coordinates.

    These are no ids of the global hexagonal index; hex_index() gives those where its library is installed.
    """
    lat, lng = _col(lat), _col(lng)
    x = (lng + 74.0) * (S.KM_PER_DEGREE * cos(radians(S.MID_LATITUDE)))
    y = (lat - S.MID_LATITUDE) * S.KM_PER_DEGREE
    q, r = (x * (sqrt(3) / 3) - y / 3) / edge_km, (y * (2 / 3)) / edge_km
    near = lambda v: F.floor(v + 0.5)
    c = F.struct(near(q).alias("q"), near(r).alias("r"), near(-q - r).alias("s"))
    dq, dr, ds = F.abs(c["q"] - q), F.abs(c["r"] - r), F.abs(c["s"] + q + r)
    own_q = F.when((dq > dr) & (dq > ds), -c["r"] - c["s"]).otherwise(c["q"])
    own_r = F.when((dq > dr) & (dq > ds), c["r"]).otherwise(F.when(dr > ds, -c["q"] - c["s"]).otherwise(c["r"]))
    known = lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
    return F.when(known, F.concat_ws(":", own_q.cast("string"), own_r.cast("string")))


def hex_index(lat="lat", lng="lng", resolution: int = 8) -> Column:
    """Ids of the global hexagonal index, if its library is installed (ImportError otherwise)."""
    import h3
    import pandas as pd

    @F.pandas_udf("string")
    def cell(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else h3.latlng_to_cell(x, y, resolution) for x, y in zip(a, b, strict=True)])

    return cell(_col(lat), _col(lng))


def trip_status() -> Column:
    ladder = (("cancelled_ts", "CANCELLED"), ("ended_ts", "COMPLETED"), ("started_ts", "IN_PROGRESS"), ("accepted_ts", "ACCEPTED"))
    return reduce(lambda out, x: F.when(F.col(x[0]).isNotNull(), x[1]).otherwise(out), reversed(ladder), F.lit("PENDING"))


def implied_kmh(km, seconds) -> Column:
    return F.when(_col(seconds) > 0, _col(km) / _col(seconds) * 3600).otherwise(0.0)


def topic_of(event_type="event_type", gps: str = S.GPS_TOPIC, trips: str = S.TRIPS_TOPIC) -> Column:
    return F.when(_col(event_type) == "gps_ping", gps).otherwise(trips)


def utc_hour_parts(ts) -> dict[str, Column]:
    """year, month, day and hour in UTC, zero-padded, whatever the session's zone is."""
    seconds = F.floor(F.unix_micros(_col(ts)) / 1_000_000)
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int"))
    parts = {"year": F.year(day), "month": F.month(day), "day": F.day(day), "hour": F.floor(F.pmod(seconds, F.lit(86_400)) / 3600)}
    return {n: F.lpad(c.cast("string"), 4 if n == "year" else 2, "0") for n, c in parts.items()}


def partition_prefix(base: str, ts, event_type) -> Column:
    """base/event_type=/year=/month=/day=/hour=/ in UTC, zero-padded."""
    at = [F.concat(F.lit(f"{n}="), c) for n, c in utc_hour_parts(ts).items()]
    return F.concat(F.lit(base.rstrip("/") + "/event_type="), _col(event_type), F.lit("/"), F.concat_ws("/", *at), F.lit("/"))


def seeded_uuid(*keys) -> Column:
    h = F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in keys]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def unit(*keys) -> Column:
    """A number in [0, 1) that the keys decide: 48 bits of a hash."""
    h = F.md5(F.concat_ws("|", *[_col(k).cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def between(low: float, high: float, *keys) -> Column:
    return F.lit(low) + F.lit(high - low) * unit(*keys)


def lerp(a, b, t) -> Column:
    return _col(a) + (_col(b) - _col(a)) * t


def bearing_deg(lat1, lng1, lat2, lng2) -> Column:
    """Initial great-circle bearing, 0 to 360."""
    p1, p2, dl = F.radians(_col(lat1)), F.radians(_col(lat2)), F.radians(_col(lng2) - _col(lng1))
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), x)) + 360.0, F.lit(360.0))


def jitter_point(zone, *keys, most_km: float | None = None) -> tuple[Column, Column]:
    """(lat, lng) of a point in a zone's disk, the same chance for equal areas; null for an unknown zone."""
    of = lambda values: F.create_map(*[F.lit(x) for n, v in values.items() for x in (n, float(v))])[_col(zone)]
    radius = of(S.ZONE_RADIUS_KM) if most_km is None else F.lit(float(most_km))
    r, theta = radius * F.sqrt(unit(*keys, F.lit("r"))), unit(*keys, F.lit("t")) * F.lit(2 * pi)
    east = S.KM_PER_DEGREE * cos(radians(S.MID_LATITUDE))
    lat, lng = of({n: a for n, (a, _) in S.ZONES.items()}), of({n: b for n, (_, b) in S.ZONES.items()})
    return lat + r * F.sin(theta) / S.KM_PER_DEGREE, lng + r * F.cos(theta) / east
