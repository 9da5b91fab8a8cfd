"""Places and lines within a radius at any latitude and over the 180th meridian, against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from daygrain.functions import geo
from daygrain.operators import joins
from daygrain.streaming.motion import with_long_stay

SPOTS = [(51.5, -0.1), (-51.5, 179.9999), (68.0, 20.0), (75.0, 10.0), (80.0, -180.0), (-85.0, 33.0), (89.99, 100.0), (0.0, 180.0)]


def near(rng, lat, lon, most_m):
    y = max(-90.0, min(90.0, lat + rng.uniform(-most_m, most_m) / 111_195))
    x = lon + rng.uniform(-most_m, most_m) / 111_195 / max(1e-6, math.cos(math.radians(lat)))
    return y, (x + 180) % 360 - 180


def metres(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1]) - math.radians(a[1])
    return 2 * geo.EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2)))


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    points = [near(rng, *s, 2400) for s in SPOTS for _ in range(40)]
    places = [near(rng, *s, 2400) for s in SPOTS for _ in range(40)]
    return points, places, spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "event_id int, lat double, lon double"), spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "place_id int, p_lat double, p_lon double")


@pytest.mark.parametrize("radius", [100.0, 1200.0])
def test_within_radius(table, radius):
    points, places, p, q = table
    want = {(i, k) for i, a in enumerate(points) for k, b in enumerate(places) if metres(a, b) <= radius}
    rows = joins.within_radius(p, q, radius).select("event_id", "place_id").collect()
    assert want and len(rows) == len(want) and {tuple(r) for r in rows} == want


def test_long_stay(table):
    points, places, p, q = table
    want = {i for i, a in enumerate(points) if any(metres(a, b) <= 100 for b in places)}
    rows = with_long_stay(p, q).collect()
    assert len(rows) == len(points) and {r["event_id"] for r in rows if r["long_stay"]} == want


@pytest.mark.parametrize("radius", [60.0, 900.0])
def test_near_lines(spark, table, radius):
    points, places, p, _ = table
    pairs = [(k, *places[k], *places[k + 1]) for k in range(len(places) - 1) if metres(places[k], places[k + 1]) < 10_000 and abs(places[k][0]) < 89]
    turn = lambda d: (d + 180) % 360 - 180

    def away(a, e):
        k = math.cos(math.radians(a[0])) * geo.M_PER_DEGREE
        x1 = turn(e[2] - a[1])
        x, y, u, v = x1 * k, (e[1] - a[0]) * geo.M_PER_DEGREE, turn(e[4] - e[2]) * k, (e[3] - e[1]) * geo.M_PER_DEGREE
        s = max(0.0, min(1.0, -(x * u + y * v) / (u * u + v * v)))
        return math.hypot(x + s * u, y + s * v)

    on = [(i, a) for i, a in enumerate(points) if abs(a[0]) < 89]
    want = {(i, e[0]) for i, a in on for e in pairs if away(a, e) <= radius}
    edges = spark.createDataFrame(pairs, "way_id int, lat1 double, lon1 double, lat2 double, lon2 double")
    rows = joins.near_lines(p.where(F.abs("lat") < 89), edges, radius, ["event_id"]).select("event_id", "way_id").collect()
    assert want and len(rows) == len(want) and {tuple(r) for r in rows} == want
