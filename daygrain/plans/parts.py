"""Queries over single operators of the day's pipeline: smoothing, sub-windows, stations, evidence, replaced children, labels. Each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrain.operators import evaluation, hsmm, joins, places, segments, series, states
from daygrain.plans.derived import FX, SP, SPAN, fixes, hav, spans, spots
from daygrain.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
U = ["user_id"]
#: The driver's segments last hours, so short is two hours here and two minutes in production.
SHORT_S = 7200


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query(f"""WITH {FX}, {SPAN}, s AS (SELECT user_id, start_ts, end_ts, event_type AS mode, 1 + event_id % 5 AS points, ((event_id * 37) % 140)::DOUBLE AS max_speed FROM span),
k AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR end_ts - start_ts >= {SHORT_S} THEN 1 ELSE 0 END AS keep FROM s WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, end_ts)),
r AS (SELECT *, sum(keep) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT user_id, min(start_ts) AS start_ts, arg_max(end_ts, (start_ts, end_ts)) AS end_ts, arg_min(mode, (start_ts, end_ts)) AS mode, sum(points)::BIGINT AS points, max(max_speed) AS max_speed FROM r GROUP BY user_id, run""")
def smooth_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("user_id", "start_ts", "end_ts", F.col("event_type").alias("mode"), (1 + F.col("event_id") % 5).alias("points"), ((F.col("event_id") * 37) % 140).cast("double").alias("max_speed"))
    return segments.smooth_short(s, U, SHORT_S)


@query(f"""WITH {FX}, d AS (SELECT DISTINCT user_id, t // 86400 * 86400 AS start_ts, t // 86400 * 86400 + 50000 AS end_ts FROM fx),
h AS (SELECT d.*, f.t, f.event_id, f.lat, f.lon, f.speed_kmh, {hav('lag(f.lat) OVER w', 'lag(f.lon) OVER w', 'f.lat', 'f.lon')} AS hop FROM d JOIN fx f ON d.user_id = f.user_id AND f.t > d.start_ts AND f.t <= d.end_ts WINDOW w AS (PARTITION BY d.user_id, d.start_ts ORDER BY f.t, f.event_id)),
a AS (SELECT user_id, start_ts, count(*) AS points, median(speed_kmh) AS med, max(speed_kmh) AS most, sum(hop) AS path, arg_min(lat, (t, event_id)) AS y1, arg_min(lon, (t, event_id)) AS x1, arg_max(lat, (t, event_id)) AS y2, arg_max(lon, (t, event_id)) AS x2 FROM h GROUP BY ALL)
SELECT d.user_id, d.start_ts, d.end_ts, coalesce(points, 0) AS points, coalesce(round(med, 1), 0.0) AS avg_speed, coalesce(round(most, 1), 0.0) AS max_speed, coalesce(CASE WHEN path > 0 THEN round(least({hav('y1', 'x1', 'y2', 'x2')} / path, 1.0), 2) END, 0.0) AS linearity FROM d LEFT JOIN a USING (user_id, start_ts)""")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fixes of a day's first fourteen hours, about, tell of it."""
    f = fixes(spark, sf_dir)
    day = F.floor(F.col("t") / 86_400) * 86_400
    parts = f.select("user_id", day.alias("start_ts"), (day + 50_000).alias("end_ts")).distinct()
    return segments.window_stats(parts, f, U, exclude_start=True)


@query(f"""WITH {FX}, {SPAN}, s AS (SELECT user_id, start_ts, end_ts, event_type, CASE WHEN spot < 3 THEN 'train' END AS refined FROM span) SELECT user_id, start_ts, end_ts, coalesce(refined, event_type) AS mode FROM s""")
def effective_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).withColumn("refined", F.when(F.col("spot") < 3, "train"))
    return s.select("user_id", "start_ts", "end_ts", segments.effective_mode(F.col("event_type"), F.col("refined")).alias("mode"))


ST = """st AS (SELECT place_id, p_lat, p_lon, CASE WHEN place_id % 4 = 1 THEN 'B' || (place_id % 10) ELSE 'Halt ' || place_id END AS name, CASE place_id % 3 WHEN 0 THEN 'station' WHEN 1 THEN 'stop_position' ELSE 'subway' END AS subtype FROM sp WHERE place_id < 100)"""


@query(f"""WITH {FX}, {SP}, {ST}, n AS (SELECT event_id, name, subtype, {hav('lat', 'lon', 'p_lat', 'p_lon')} AS distance_m FROM fx JOIN st ON abs(lat - p_lat) < 0.05),
t AS (SELECT *, CASE WHEN subtype = 'subway_entrance' OR regexp_matches(name, '^[A-Z][0-9]?$') THEN 3 WHEN subtype = 'stop_position' THEN 2 WHEN subtype = 'subway' THEN 0 ELSE 1 END AS tier FROM n WHERE distance_m <= 3000)
SELECT event_id, name, tier, row_number() OVER (PARTITION BY event_id ORDER BY tier, distance_m, name) AS rank FROM t""")
def rank_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations within three kilometres of each event, the best for an underground ride first."""
    i = F.col("place_id")
    st = spots(spark).where("place_id < 100").select(
        "p_lat", "p_lon", F.when(i % 4 == 1, F.concat(F.lit("B"), (i % 10).cast("string"))).otherwise(F.concat(F.lit("Halt "), i.cast("string"))).alias("name"),
        F.when(i % 3 == 0, "station").when(i % 3 == 1, "stop_position").otherwise("subway").alias("subtype"),
    )
    near = joins.within_radius(fixes(spark, sf_dir).select("event_id", "lat", "lon"), st, 3000.0)
    return places.rank_stations(near, ["event_id"], prefer="subway").select("event_id", "name", "tier", "rank")


KEY = "regexp_replace(lower(name), '[^a-z0-9]', '', 'g')"


@query(f"""WITH c AS (SELECT c_mktsegment AS line, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT DISTINCT line, {KEY} AS stop FROM (SELECT line, n_name AS name FROM c WHERE c_acctbal > 3000)),
k AS (SELECT line FROM s GROUP BY line HAVING count(*) >= 5), a AS (SELECT DISTINCT line, n_name AS name FROM c UNION SELECT DISTINCT line, n_name || ' (Main)' FROM c),
h AS (SELECT DISTINCT a.line, a.name FROM (SELECT *, {KEY} AS key FROM a) a JOIN s ON a.line = s.line AND (key = stop OR (least(length(key), length(stop)) >= 10 AND (contains(key, stop) OR contains(stop, key)))))
SELECT a.line, a.name, CASE WHEN k.line IS NOT NULL THEN h.name IS NOT NULL END AS served FROM a LEFT JOIN k ON a.line = k.line LEFT JOIN h ON a.line = h.line AND a.name = h.name""")
def served_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as lines, nations of their richer customers as stops."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    c = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("line"), "c_acctbal", F.col("n_name").alias("name"))
    asked = c.select("line", "name").distinct()
    return places.served(c.where("c_acctbal > 3000").select("line", "name"), asked.unionByName(asked.withColumn("name", F.concat("name", F.lit(" (Main)")))))


@query(f"""WITH {FX}, w AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'stationary' WHEN 'click' THEN 'walking' WHEN 'purchase' THEN 'driving' WHEN 'signup' THEN 'train' ELSE 'unknown' END AS mode, steps * 30 AS steps,
  CASE WHEN lag(t) OVER o IS NOT NULL AND lead(t) OVER o IS NOT NULL THEN {hav('lag(lat) OVER o', 'lag(lon) OVER o', 'lead(lat) OVER o', 'lead(lon) OVER o')} END AS m, greatest(0, lead(t) OVER o - lag(t) OVER o - 1800) / 60.0 AS slop FROM fx WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)),
p AS (SELECT *, CASE mode WHEN 'stationary' THEN 0.0 WHEN 'walking' THEN steps * 0.75 WHEN 'driving' THEN 11000.0 WHEN 'train' THEN 14000.0 END::DOUBLE AS predicted, CASE mode WHEN 'stationary' THEN 200.0 WHEN 'walking' THEN greatest(steps * 0.3, 200.0) WHEN 'driving' THEN 6000.0 WHEN 'train' THEN 7000.0 END::DOUBLE AS sigma FROM w)
SELECT event_id, CASE WHEN nats > -5e-7 THEN 0.0 ELSE round(nats, 6) END::DOUBLE AS nats FROM (SELECT event_id, CASE WHEN m IS NULL OR predicted IS NULL THEN 0.0 ELSE greatest(-6.0, -0.5 * pow(m - predicted, 2) / (sigma * sigma + pow(500 * slop, 2))) END AS nats FROM p)""")
def segment_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half an hour about each event as a segment of a mode, held against the way between the events before and after it."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    f = fixes(spark, sf_dir)
    mode = F.when(F.col("event_type") == "view", "stationary").when(F.col("event_type") == "click", "walking").when(F.col("event_type") == "purchase", "driving").when(F.col("event_type") == "signup", "train").otherwise("unknown")
    m = joins.geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.lead("lat").over(w), F.lead("lon").over(w))
    slop = F.greatest(F.lit(0), F.lead("t").over(w) - F.lag("t").over(w) - 1800)
    f = f.select("event_id", mode.alias("mode"), (F.col("steps") * 30).alias("steps"), m.alias("m"), F.when(F.lag("t").over(w).isNotNull() & F.lead("t").over(w).isNotNull(), slop).alias("slop"))
    nats = hsmm.segment_evidence(F.col("mode"), F.col("m"), F.col("slop"), F.col("steps"), F.lit(1800.0))
    return f.select("event_id", nats.alias("nats")).withColumn("nats", F.when(F.col("nats") > -5e-7, 0.0).otherwise(F.round("nats", 6)))  # no zero has a sign


RIDES = """r AS (SELECT user_id, start_ts, end_ts, CASE event_type WHEN 'view' THEN 'train' ELSE 'bus' END AS mode, spot, event_type FROM span WHERE event_type IN ('view', 'click')),
g AS (SELECT *, CASE WHEN event_type = 'click' AND spot = 0 THEN NULL ELSE 'S' || spot END AS board, 'T' || spot AS alight, row_number() OVER () AS leg FROM r),
d AS (SELECT user_id, start_ts + 900 AS start_ts, end_ts + 900 AS end_ts, mode, CASE WHEN spot = 5 THEN NULL ELSE 's' || spot END AS board, CASE WHEN spot >= 6 THEN 'T' ELSE 'X' END || spot AS alight FROM r)"""


@query(f"""WITH {FX}, {SPAN}, {RIDES}, m AS (SELECT g.leg, arg_min((d.board, d.alight), (-(least(g.end_ts, d.end_ts) - greatest(g.start_ts, d.start_ts)), d.start_ts)) AS b FROM g JOIN d ON g.user_id = d.user_id AND g.mode = d.mode
  AND (least(g.end_ts, d.end_ts) - greatest(g.start_ts, d.start_ts)) * 2 > g.end_ts - g.start_ts WHERE g.board IS NOT NULL GROUP BY g.leg)
SELECT count(*) AS asserted, count(*) FILTER (lower(b[1]) = lower(board) AND lower(b[2]) = lower(alight)) AS matching, count(*) FILTER (b[1] IS NULL OR b[2] IS NULL) AS missing FROM g LEFT JOIN m USING (leg) WHERE board IS NOT NULL""")
def score_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides as they were against a decoding fifteen minutes late that names some stations wrong and some not at all."""
    r = spans(spark, sf_dir).where("event_type in ('view', 'click')").withColumn("mode", F.when(F.col("event_type") == "view", "train").otherwise("bus"))
    named = lambda p: F.concat(F.lit(p), F.col("spot").cast("string"))
    truth = r.select("user_id", "start_ts", "end_ts", "mode", F.when(~((F.col("event_type") == "click") & (F.col("spot") == 0)), named("S")).alias("board"), named("T").alias("alight"))
    late = r.select("user_id", (F.col("start_ts") + 900).alias("start_ts"), (F.col("end_ts") + 900).alias("end_ts"), "mode", F.when(F.col("spot") != 5, named("s")).alias("board"), F.when(F.col("spot") >= 6, named("T")).otherwise(named("X")).alias("alight"))
    return evaluation.score_stations(truth, late, U)


@query("""WITH m AS (SELECT quantile_disc(o_orderdate, 0.9) AS cut FROM orders), n AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders, m WHERE o_orderdate >= cut), o AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders, m WHERE o_orderdate < cut)
SELECT * FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT * FROM n""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer that has new ones replaced by those."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    cut = o.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY unix_micros(cast(o_orderdate AS timestamp)))").alias("cut")).first()["cut"]
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return sinks.replace_children(o.where(at < cut).drop("o_orderdate"), o.where(at >= cut).drop("o_orderdate"), ["o_custkey"])


@query("""WITH r AS (SELECT user_id, min(floor(epoch(ts))::BIGINT) AS first_ts, max(floor(epoch(ts))::BIGINT) AS last_ts FROM events GROUP BY user_id), q AS (SELECT *, greatest(1, last_ts - first_ts) AS total_s FROM r)
SELECT user_id, first_ts, last_ts, total_s, array_to_string(list_transform(range(0, 5), lambda i: strftime(make_timestamp((floor(first_ts + total_s * i / 4.0) * 1000000)::BIGINT), '%H:%M')), ',') AS labels FROM q""")
def chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time axis of each user's series."""
    out = series.time_labels(fixes(spark, sf_dir), U, 4)
    return out.withColumn("labels", F.array_join("labels", ","))


@query(f"""WITH {FX}, {SPAN}, c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR start_ts > lag(end_ts) OVER w THEN 1 ELSE 0 END AS new FROM span WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, end_ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS island FROM c) SELECT user_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, any_value(event_type) AS mode FROM i GROUP BY user_id, island""")
def states_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("user_id", "start_ts", "end_ts", F.col("event_type").alias("mode"))
    return states.merge_touching(s, U, ["mode"])


@query(f"""WITH {FX}, {SP}, n AS (SELECT event_id, place_id, {hav('lat', 'lon', 'p_lat', 'p_lon')} AS m FROM fx JOIN sp ON abs(lat - p_lat) < 0.06) SELECT event_id, place_id, round(m, 3) AS distance_m FROM n WHERE m <= 5000 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY m, place_id) <= 50""")
def radius_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places within five kilometres of each event, the nearest fifty at most."""
    near = joins.within_radius(fixes(spark, sf_dir).select("event_id", "lat", "lon"), spots(spark).select("place_id", "p_lat", "p_lon"), 5000.0)
    return joins.nearest_k(near, ["event_id"], 50, "place_id").select("event_id", "place_id", F.round("distance_m", 3).alias("distance_m"))


@query(f"""WITH {FX}, d AS (SELECT DISTINCT user_id, t // 86400 AS day FROM fx) SELECT user_id, day FROM d WHERE EXISTS (SELECT 1 FROM fx WHERE fx.user_id = d.user_id AND fx.t // 86400 = d.day AND bpm >= 140)""")
def existence_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users with a heart rate of 140 or more."""
    f = fixes(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400))
    return f.select("user_id", "day").distinct().join(f.where("bpm >= 140"), ["user_id", "day"], "left_semi")
