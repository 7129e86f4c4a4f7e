"""Fixed values of the domain: thresholds, windows, watermarks, and the places they apply to."""

#: min lat, min lng, max lat, max lng; inclusive.
BBOX = (40.45, -74.30, 40.95, -73.65)
#: Zone centroids, in the order that decides ties (the last of the nearest wins).
ZONES = {
    "Manhattan": (40.7831, -73.9712),
    "Brooklyn": (40.6782, -73.9442),
    "Queens": (40.7282, -73.7949),
    "Bronx": (40.8448, -73.8648),
    "Staten Island": (40.5795, -74.1502),
    "EWR": (40.6895, -74.1745),
}
KM_PER_DEGREE = 111.0
MID_LATITUDE = 40.7
EARTH_KM = 6371.0088
MAX_SPEED_KMH = 200.0
MAX_ACCURACY_M = 500.0
START_SLACK, END_SLACK = "30 seconds", "5 minutes"
#: Bounds the join's state: a ping is not older than this against its trip's last event.
TRIP_SPAN = "270 minutes"
PING_WATERMARK, TRIP_WATERMARK, MART_WATERMARK = "10 minutes", "30 minutes", "10 minutes"
ACTIVE_WINDOW, DEMAND_WINDOW, FRAUD_WINDOW = "1 minute", "5 minutes", "5 minutes"
TELEPORT_KMH, TELEPORT_SECONDS, TELEPORT_KM = 200.0, 1.0, 0.5
SAMPLE_TRIPS = 5
#: Edge of a hex cell in km, about that of the usual resolution 8.
HEX_EDGE_KM = 0.531
#: How far pick-ups and drop-offs lie around a zone's centroid, in km.
ZONE_RADIUS_KM = {"Manhattan": 3.5, "Brooklyn": 5.0, "Queens": 6.0, "Bronx": 4.5, "Staten Island": 5.0, "EWR": 2.0}
KM_PER_MILE = 1.609344
LONGEST_HIRE = "4 hours"
#: Seconds from request to pick-up, and from request to acceptance; noise of speed in km/h and of coordinates in degrees.
REQUEST_SECONDS, ACCEPT_SECONDS = (30.0, 120.0), (5.0, 30.0)
SPEED_NOISE, DEGREE_NOISE, MOST_PINGS = 5.0, 1e-4, 3600
GPS_TOPIC, TRIPS_TOPIC = "rides.gps.v1", "rides.trips.v1"
