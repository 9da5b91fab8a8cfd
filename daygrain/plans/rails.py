"""Queries over rides on rails: candidates, robust slopes, the stations of successive rides. The network lies on the derived spots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrain.operators import hsmm, rail, routes
from daygrain.plans.derived import FX, SPAN, SPOTS, fixes, hav, spans

KEYS = ["user_id", "day"]
#: Lines as the spots that they join, in order: one along all, one along the odd ones, and one in two parts that nothing joins.
LINES = {"Ring": [list(range(SPOTS))], "North": [list(range(1, SPOTS, 2))], "Split": [[0, 2, 4], [6, 8, 10]]}


def _network(spark: SparkSession) -> rail.Network:
    place = lambda i: (51.5 + i * 0.01, -0.1 + i * 0.015)
    stations = spark.createDataFrame([(i, f"Halt {i}", *place(i)) for i in range(SPOTS)], "station_id long, name string, p_lat double, p_lon double")
    legs = [(line, a, b) for line, parts in LINES.items() for part in parts for a, b in zip(part[:-1], part[1:], strict=True)]
    edges = spark.createDataFrame([(line, a, *place(a), *place(b)) for line, a, b in legs], "line string, edge_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    return rail.network(stations, edges)


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400)).withColumn("m", F.floor(F.pmod(F.col("t"), F.lit(86_400)) / 60))


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fixes(spark, sf_dir)
    return f.groupBy(*KEYS, "m").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.avg("speed_kmh").alias("speed_kmh"))


def train_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides between two stations that each user's days allow."""
    return rail.train_candidates(_minutes(spark, sf_dir), KEYS, _network(spark))


def day_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robust line through the latitudes of each user's days, by the hour."""
    p = _fixes(spark, sf_dir).select(*KEYS, (F.pmod(F.col("t"), F.lit(86_400)) / 3600).alias("t"), F.col("lat").alias("d"))
    s = rail.slopes(p, KEYS)
    return s.select(*KEYS, "n", *((F.round(c, 6) + 0.0).alias(c) for c in ("slope", "intercept", "mad")))


def _rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of purchases and errors as rides on two lines."""
    s = spans(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    line = F.when(F.col("event_type") == "error", "North").otherwise("Ring")
    return s.select("user_id", F.floor(F.col("start_ts") / 86_400).alias("day"), F.col("event_id").alias("ride"), "start_ts", "end_ts", line.alias("line"))


def chain_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stations near the last fix before each ride and the first after it, as a day tells them, and what that says for each, in nats."""
    rides = _rides(spark, sf_dir)
    f = fixes(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400)).select(*KEYS, "t", "event_id", "lat", "lon")
    s = rail.chain_sides(rides, f, KEYS, _network(spark), c=rail.Chain(most=100, admit_min=-1.0), tie="event_id")
    return s.where("slop_min is not null").select("ride", "side", "station_id", (F.round("anchor", 4) + 0.0).alias("anchor"), F.round("slop_min", 4).alias("slop_min"))


def station_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board and alight of each ride, a day's rides together."""
    f = fixes(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400)).select(*KEYS, "t", "lat", "lon")
    return rail.station_chain(_rides(spark, sf_dir), f, KEYS, _network(spark)).select("user_id", "day", "ride", "board", "alight", F.round("score", 6).alias("score"))


def route_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days decoded by the half hour, rides on named lines with the edges that they take."""
    f = fixes(spark, sf_dir).withColumn("day_start", F.floor(F.col("t") / 86_400) * 86_400)
    seen = hsmm.observations(f, ["user_id", "day_start"], 1800).select("user_id", "day_start", "t", "lat", "lon", "speed_kmh", "hr", "cadence")
    where = hsmm.steps_seen(f, ["user_id", "day_start"], 1800)
    edges = _network(spark).edges.withColumn("edge_id", F.col("edge_id").cast("string")).withColumn("underground", F.col("line") == "North")
    out = routes.decode_routes(seen, ["user_id", "day_start"], edges, step_s=1800, fixes=where, dealt=True)
    return out.select("user_id", "start_ts", "end_ts", "mode", "line", F.array_join("edges", ",").alias("edges"))


QUERIES = {f.__name__: f for f in (train_candidates, day_slopes, chain_anchors, station_chain, route_decode)}

PATHS = "pth AS (SELECT a.line, a.i AS x, b.i AS y FROM st a JOIN st b ON a.line = b.line AND a.part = b.part AND a.i <> b.i)"
STOPS = """st AS (SELECT 'Ring' AS line, 0 AS part, i FROM range(12) r(i) UNION ALL SELECT 'North', 0, i FROM range(12) r(i) WHERE i % 2 = 1 UNION ALL SELECT 'Split', (i > 5)::INT, i FROM range(12) r(i) WHERE i % 2 = 0)"""
NEAREST = """(SELECT {c} FROM mi x WHERE x.user_id = w.user_id AND x.day = w.day ORDER BY abs(x.m - {at}), x.m LIMIT 1)"""
ORACLES = {
    "train_candidates": f"""WITH {FX}, {STOPS}, {PATHS},
mi AS (SELECT user_id, t // 86400 AS day, t % 86400 // 60 AS m, median(lat) AS lat, median(lon) AS lon, avg(speed_kmh) AS kmh FROM fx GROUP BY 1, 2, 3),
l AS (SELECT *, lag(m) OVER o AS pm, lag(lat) OVER o AS plat, lag(lon) OVER o AS plon, lead(m) OVER o AS nm, lead(lat) OVER o AS nlat, lead(lon) OVER o AS nlon FROM mi WINDOW o AS (PARTITION BY user_id, day ORDER BY m)),
q AS (SELECT *, coalesce(m - pm > 1 AND {hav('plat', 'plon', 'lat', 'lon')} / 1000 / ((m - pm) / 60.0) >= 12, false) OR coalesce(nm - m > 1 AND {hav('lat', 'lon', 'nlat', 'nlon')} / 1000 / ((nm - m) / 60.0) >= 12, false) OR kmh >= 12 AS ok FROM l),
i AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, day ORDER BY m ROWS UNBOUNDED PRECEDING) AS run FROM q),
r AS (SELECT user_id, day, min(m) AS a, max(m) AS b, max(kmh) AS peak, avg(kmh) AS mean, arg_min(lat, m) AS la, arg_min(lon, m) AS lo, arg_max(lat, m) AS lb, arg_max(lon, m) AS lp,
  arg_min({{'m': pm, 'lat': plat, 'lon': plon}}, m) AS p, arg_max({{'m': nm, 'lat': nlat, 'lon': nlon}}, m) AS n FROM i WHERE ok GROUP BY user_id, day, run),
k AS (SELECT *, CASE WHEN b > a THEN {hav('la', 'lo', 'lb', 'lp')} / 1000 / ((b - a) / 60.0) ELSE 0 END AS implied, {hav('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS hop FROM r),
w AS (SELECT user_id, day, a, a + least(b - a + 1, 90) - 1 AS b FROM k WHERE (b > a OR coalesce(hop >= 400 AND hop / 1000 / ((n.m - p.m) / 60.0) >= 12, false)) AND (peak >= 25 OR implied >= 12) AND (mean >= 12 OR implied >= 12)),
e AS (SELECT *, {NEAREST.format(c="{'lat': lat, 'lon': lon}", at='greatest(w.a - 1, 0)')} AS f, {NEAREST.format(c="{'lat': lat, 'lon': lon}", at='least(w.b + 1, 1439)')} AS g FROM w),
d AS (SELECT e.*, i AS s, 51.5::DOUBLE + i * 0.01::DOUBLE AS y, -0.1::DOUBLE + i * 0.015::DOUBLE AS z FROM e, range(12) r(i))
SELECT x.user_id, x.day, x.a AS start_min, x.b AS end_min, pth.line, x.s AS board, v.s AS alight FROM d x JOIN pth ON pth.x = x.s JOIN d v ON v.user_id = x.user_id AND v.day = x.day AND v.a = x.a AND v.s = pth.y
WHERE {hav('x.f.lat', 'x.f.lon', 'x.y', 'x.z')} <= 250 AND {hav('v.g.lat', 'v.g.lon', 'v.y', 'v.z')} <= 250""",
    "day_slopes": f"""WITH {FX}, p AS (SELECT user_id, t // 86400 AS day, t % 86400 / 3600.0::DOUBLE AS t, lat AS d, event_id FROM fx),
s AS (SELECT a.user_id, a.day, median((b.d - a.d) / (b.t - a.t)) AS v FROM p a JOIN p b ON a.user_id = b.user_id AND a.day = b.day AND a.event_id < b.event_id AND a.t <> b.t GROUP BY 1, 2),
c AS (SELECT p.*, coalesce(s.v, 0) AS v, median(p.d - coalesce(s.v, 0) * p.t) OVER (PARTITION BY p.user_id, p.day) AS c FROM p LEFT JOIN s ON p.user_id = s.user_id AND p.day = s.day)
SELECT user_id, day, count(*) AS n, round(any_value(v), 6) + 0.0 AS slope, round(any_value(c), 6) + 0.0 AS intercept, round(median(abs(d - (v * t + c))), 6) + 0.0 AS mad FROM c GROUP BY 1, 2""",
    "chain_anchors": f"""WITH {FX}, {SPAN}, ride AS (SELECT user_id, start_ts // 86400 AS day, event_id AS ride, start_ts, end_ts, CASE WHEN event_type = 'error' THEN 'North' ELSE 'Ring' END AS line FROM span WHERE event_type IN ('purchase', 'error')),
one AS (SELECT user_id, t // 86400 AS day, t, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon FROM fx GROUP BY 1, 2, 3),
an AS (SELECT ride.*, 'board' AS side, one.lat, one.lon, (start_ts - one.t) / 60.0::DOUBLE AS slop FROM ride ASOF JOIN one ON ride.user_id = one.user_id AND ride.day = one.day AND ride.start_ts - 1 >= one.t
  UNION ALL SELECT ride.*, 'alight', one.lat, one.lon, (one.t - end_ts) / 60.0::DOUBLE FROM ride ASOF JOIN one ON ride.user_id = one.user_id AND ride.day = one.day AND ride.end_ts <= one.t),
d AS (SELECT an.*, i, {hav('lat', 'lon', '(51.5::DOUBLE + i * 0.01::DOUBLE)', '(-0.1::DOUBLE + i * 0.015::DOUBLE)')} AS m FROM an, range(12) r(i) WHERE line = 'Ring' OR i BETWEEN 1 AND 11)
SELECT ride, side, i AS station_id, round(greatest(-6.0, -0.5 * pow(m / sqrt(40000.0::DOUBLE + pow(500 * slop, 2)), 2)), 4) + 0.0 AS anchor, round(slop, 4) AS slop_min FROM d WHERE m <= 800 + 500 * slop""",
}
