"""Queries over a day's track: kernels, segments, the cascade, places, decoding, streams. Their results are recursions that SQL can't state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrain.cluster import staged
from daygrain.functions import geo
from daygrain.operators import aggregates, context, episodes, evaluation, evidence, groups, hsmm, joins, passes, places, segments, series, states, track, ways
from daygrain.plans.derived import FX, SP, SPAN, SPOTS, events, fixes, hav, spans, spots
from daygrain.streaming import motion

#: The driver's tracks are sparse, so windows are of a day here and of five minutes in production.
WINDOW_S = 86_400
KEYS = ["user_id"]
#: A station at each spot, in turn of two lines and all of a third.
STATIONS = [{"name": f"Halt {i}", "lat": 51.5 + i * 0.01, "lon": -0.1 + i * 0.015, "lines": ["Ring", "North" if i % 2 else "South"]} for i in range(SPOTS)]


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = joins.snap(fixes(spark, sf_dir), spots(spark).select("place_id", "p_lat", "p_lon"), ["event_id"])
    return f.select("user_id", "event_id", "t", "lat", "lon", "accuracy")


def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.filter_quality(fixes(spark, sf_dir).select("user_id", "event_id", "t", "lat", "lon", "accuracy"), KEYS).select("user_id", "event_id")


def kalman_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.smoothed(_track(spark, sf_dir), KEYS).drop("win")


def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place snap, quality filter, Kalman filter, windows, mode scores, runs."""
    k = track.smoothed(_track(spark, sf_dir), KEYS, span_s=WINDOW_S)
    w = segments.score_windows(segments.window_features(k, KEYS, "t"))
    return segments.merge_windows(w, KEYS)


def day_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with what lies between them, cut and joined on evidence, refined by the cascade (with rides under ground, and the places that a user often goes to), cut into states. Each kernel
    runs once: what is read more than once is written between."""
    f = fixes(spark, sf_dir)
    s = staged(track_segments(spark, sf_dir), "segments").withColumn("place", F.lit(None).cast("long"))
    near = places.current_place(s.select("user_id", "start_ts", "lat", "lon").distinct(), spots(spark).select("place_id", "p_lat", "p_lon"), ["user_id", "start_ts"])
    s = s.drop("place").join(near.select("user_id", "start_ts", F.col("place_id").alias("place")), ["user_id", "start_ts"], "left")
    g = segments.transit_gaps(s, f, KEYS).select("user_id", "start_ts", "end_ts", "mode", "confidence", "avg_speed")
    both = s.unionByName(g, allowMissingColumns=True).fillna({"points": 0})
    often = f.groupBy("user_id", "spot").agg(F.count("*").alias("n")).where("n >= 5")
    focus = often.join(spots(spark), F.col("spot") == F.col("place_id")).select("user_id", F.col("spot").alias("place"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))
    refined = staged(passes.cascade(both, f.select("user_id", "t", "lat", "lon", "speed_kmh", "accuracy"), f.select("user_id", "t", "steps"), KEYS, STATIONS, focus=focus, rails=_rails(spark), heart=f.select("user_id", "t", "bpm")), "refined")
    night = F.floor(F.col("start_ts") / 86_400) * 86_400
    z = refined.select("user_id", night.alias("start_ts"), (night + 21_600).alias("end_ts")).distinct().withColumn("place", F.lit(None).cast("long"))
    return states.day_states(refined.select("user_id", "start_ts", "end_ts", "mode", "place"), z, KEYS)


def _rails(spark: SparkSession) -> DataFrame:
    """Railways through the stations of each line."""
    at = {line: [s for s in STATIONS if line in s["lines"]] for line in ("Ring", "North", "South")}
    legs = [(line, a["lat"], a["lon"], b["lat"], b["lon"]) for line, some in at.items() for a, b in zip(some[:-1], some[1:], strict=True)]
    return spark.createDataFrame(legs, "line string, lat1 double, lon1 double, lat2 double, lon2 double")


def stay_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track.stays(fixes(spark, sf_dir).where("accuracy <= 200").select("user_id", "event_id", "t", "lat", "lon"), KEYS)


def focus_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined stays, their clusters, and what each cluster is."""
    c = staged(track.clusters(spans(spark, sf_dir).join(spots(spark), F.col("spot") == F.col("place_id")).select("user_id", "start_ts", "end_ts", F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon")), KEYS), "clusters")
    key = ["user_id", "cluster"]
    centre = c.groupBy(*key).agg(F.avg("lat").alias("c_lat"), F.avg("lon").alias("c_lon"))
    shift = F.floor(F.col("lon") / 15 * 3600)
    st = aggregates.cluster_stats(c.withColumn("local_shift_s", shift), key, centre).join(centre, key)
    span = F.floor((F.col("last_ts") - F.col("first_ts")) / 86_400)
    return st.withColumn("label", aggregates.cluster_label(span, F.col("days"), F.col("overnight"), F.col("weekday_day")))


def split_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What steps and heart tell of the gaps between each user's clicks and views of a day."""
    f = fixes(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400))
    g = evidence.gap_scores(f.where(F.col("event_type").isin("click", "view")).select("user_id", "day", "event_id", "t", "lat", "lon"), f.select("user_id", "day", "t", "steps"), f.select("user_id", "day", "t", "bpm"), ["user_id", "day"], "event_id")
    return g.select("user_id", "start_ts", "end_ts", "fixes", "steps", "beats", F.round("bpm", 4).alias("bpm"), F.round("median_gap_s", 1).alias("median_gap_s"), F.round("nats", 4).alias("nats"))


def state_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of each span: clicks and views are stays, the others rides."""
    mode = F.when(F.col("event_type").isin("click", "view"), "stationary").otherwise("driving")
    e = episodes.episodes(spans(spark, sf_dir).withColumn("mode", mode), fixes(spark, sf_dir), KEYS)
    return e.select("user_id", "start_ts", "end_ts", "mode", "kind", "seen", F.size("points").cast("long").alias("n_points"), F.round("length_m", 2).alias("length_m"))


def greedy_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New clusters matched with those of the first half of the month."""
    s = spans(spark, sf_dir).join(spots(spark), F.col("spot") == F.col("place_id"))
    mid = 1_705_276_800
    side = lambda on, n: s.where(on).groupBy("user_id", "spot").agg(F.avg("p_lat").alias(f"{n}lat"), F.avg("p_lon").alias(f"{n}lon")).withColumnRenamed("spot", f"{n}id")
    old, new = side(F.col("start_ts") < mid, "old_"), side(F.col("start_ts") >= mid, "new_")
    d = geo.haversine(F.col("old_lat"), F.col("old_lon"), F.col("new_lat"), F.col("new_lon"))
    pairs = old.join(new, "user_id").withColumn("distance_m", d).where("distance_m <= 1800")
    return track.match_identity(pairs.select("user_id", F.col("old_id"), F.col("new_id"), "distance_m"), KEYS).withColumn("distance_m", F.round("distance_m", 3))


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations of each user's days, by hours."""
    f = fixes(spark, sf_dir).withColumn("day_start", F.floor(F.col("t") / 86_400) * 86_400)
    return hsmm.observations(f, ["user_id", "day_start"], 3600).select("user_id", "day_start", "t", "speed_kmh", "hr", "cadence")


def class_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What steps and fixes prove of each quarter of an hour of each user's days."""
    f = fixes(spark, sf_dir).withColumn("day_start", F.floor(F.col("t") / 86_400) * 86_400)
    seen = hsmm.observations(f, ["user_id", "day_start"], 900)
    return hsmm.class_locks(seen, ["user_id", "day_start"]).where("lock is not null").select("user_id", "t", "lock")


def day_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The semi-Markov decoding of each user's days, by hours."""
    return hsmm.decode(_hours(spark, sf_dir), ["user_id", "day_start"], step_s=3600, dealt=True)


def context_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days by the half hour, with the spots as places: how far they are, how often a user is there, nights in bed, class locks, and the way between fixes."""
    f = groups.dealt(fixes(spark, sf_dir), ["user_id"]).withColumn("day_start", F.floor(F.col("t") / 86_400) * 86_400)
    at = {i: (51.5 + i * 0.01, -0.1 + i * 0.015) for i in range(SPOTS)}
    user = Window.partitionBy("user_id")
    often = F.array(*[F.log((F.sum((F.col("spot") == i).cast("int")).over(user) + 1) / (F.count("*").over(user) + SPOTS)) for i in at])
    return context.decode_fixes(f.withColumn("often", often), ["user_id", "day_start"], at, "often", (0, 6 * 3600), 1800, dealt=True)


def decode_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How probable each mode is at each hour of each user's days."""
    return hsmm.likeliest(_hours(spark, sf_dir), ["user_id", "day_start"], step_s=3600, dealt=True)


def road_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's days matched to a road through all spots."""
    at = lambda i: (51.5 + i * 0.01, -0.1 + i * 0.015)
    road = spark.createDataFrame([(i, *at(i), *at(i + 1)) for i in range(11)], "way_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    f = fixes(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400)).select("user_id", "day", "t", "lat", "lon")
    return ways.match_legs(f, ["user_id", "day"], road).withColumn("points", F.coalesce(F.size("path"), F.lit(0))).select("user_id", "day", "points", F.round(geo.path_length(F.col("path")), 3).alias("path_m"))


def circle_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type and spot in two groups by the time of day."""
    f = fixes(spark, sf_dir).select("event_type", "spot", "t", "event_id")

    def work(g):
        return g[["event_id"]].assign(side=track.circle_kmeans(g.t.to_numpy(float) % 86_400 / 3600))

    return track.by_group(f, ["event_type", "spot"], ["t", "event_id"], work, "event_id long, side long")


def _messages(f: DataFrame) -> DataFrame:
    return f.select(F.col("user_id").cast("string").alias("device"), "t", F.col("event_id").alias("seq"), "lat", "lon", F.col("speed_kmh").alias("vel"), F.when(F.col("event_type") == "signup", "u").alias("trigger"), (F.col("spot") == 0).alias("long_stay"))


def stream_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion profiles, message by message; tests hold the stream against this batch."""
    return motion.motion_batch(_messages(fixes(spark, sf_dir)))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows of users, as the stream computes them."""
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = motion.session_windows(e, ["user_id"], "4 hours")
    return out.select("user_id", F.unix_timestamp("start").alias("start_ts"), F.unix_timestamp("end").alias("end_ts"), "n")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = motion.tumbling(e, ["event_type"], "value", "1 hour")
    return out.select("event_type", F.unix_timestamp("start").alias("start_ts"), "n", F.round("total", 4).alias("total"))


def feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).join(spots(spark), F.col("spot") == F.col("place_id")).select("user_id", "start_ts", "end_ts", F.when(F.col("event_type") == "view", "walking").otherwise("stationary").alias("mode"), F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), (F.col("event_id") % 40).alias("avg_speed"))
    return states.infeasible(s, KEYS, {"walking": 15.0, "cycling": 60.0, "driving": 250.0})


def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).select("user_id", "start_ts", "end_ts", F.col("event_type").alias("mode"))
    b = s.withColumn("mode", F.when(F.col("start_ts") % 7 == 0, "other").otherwise(F.col("mode")))
    return evaluation.state_diff(s, b, KEYS, ["mode"]).select("user_id", "ix", "kind")


def dwell_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).join(spots(spark), F.col("spot") == F.col("place_id"))
    last = s.groupBy("user_id").agg(F.max_by(F.struct(F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"), "end_ts"), F.struct("start_ts", "event_id")).alias("l")).select("user_id", "l.*")
    known = s.groupBy("user_id", "place_id").agg(F.first("p_lat").alias("p_lat"), F.first("p_lon").alias("p_lon"), F.countDistinct(F.floor(F.col("start_ts") / 86_400)).alias("days"), F.sum(F.col("end_ts") - F.col("start_ts")).alias("dwell_s"), F.count("*").alias("visits"))
    return states.dwell_continuation(last, known, KEYS)


def trailing_600s(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = series.trailing(fixes(spark, sf_dir), KEYS, ["t", "event_id"])
    return t.select("event_id", *[F.round(c, n).alias(c) for c, n in (("path_m", 3), ("net_m", 3), ("effective_kmh", 3), ("straightness", 6))])


QUERIES = {
    f.__name__: f
    for f in (
        quality_filter, kalman_filter, track_segments, day_timeline, split_scores, state_episodes, stay_mining, focus_places, greedy_identity, class_locks, day_decode, context_decode, decode_marginals, road_match, circle_kmeans, stream_motion, stream_session, stream_tumbling, feasibility, state_diff,
        dwell_continuation, trailing_600s,
    )
}
MODED = f"""m AS (SELECT user_id, start_ts, end_ts, event_id, event_type, p_lat AS lat, p_lon AS lon FROM span JOIN sp ON spot = place_id)"""
ORACLES = {
    "state_episodes": f"""WITH {FX}, {SPAN}, s AS (SELECT user_id, start_ts, end_ts, CASE WHEN event_type IN ('click', 'view') THEN 'stationary' ELSE 'driving' END AS mode FROM span),
p AS (SELECT s.*, fx.lat, fx.lon, {hav('lag(fx.lat) OVER w', 'lag(fx.lon) OVER w', 'fx.lat', 'fx.lon')} AS hop, row_number() OVER w AS k FROM s JOIN fx ON fx.user_id = s.user_id AND fx.t BETWEEN s.start_ts AND s.end_ts
  WINDOW w AS (PARTITION BY s.user_id, s.start_ts, s.end_ts, s.mode ORDER BY fx.t, fx.lat, fx.lon))
SELECT user_id, start_ts, end_ts, mode, CASE WHEN mode = 'stationary' THEN 'anchor' ELSE 'raw' END AS kind, count(*) AS seen, CASE WHEN mode = 'stationary' THEN 1 ELSE count(*) END::BIGINT AS n_points,
  round(CASE WHEN mode = 'stationary' THEN 0 ELSE coalesce(sum(hop) FILTER (k > 1), 0) END::DOUBLE, 2) AS length_m FROM p GROUP BY 1, 2, 3, 4""",
    "greedy_identity": f"""WITH RECURSIVE {FX}, {SP}, {SPAN}, s AS (SELECT * FROM span JOIN sp ON spot = place_id),
o AS (SELECT user_id, spot AS old_id, avg(p_lat) AS y, avg(p_lon) AS x FROM s WHERE start_ts < 1705276800 GROUP BY 1, 2), w AS (SELECT user_id, spot AS new_id, avg(p_lat) AS y, avg(p_lon) AS x FROM s WHERE start_ts >= 1705276800 GROUP BY 1, 2),
p AS (SELECT o.user_id, old_id, new_id, {hav('o.y', 'o.x', 'w.y', 'w.x')} AS distance_m FROM o JOIN w ON o.user_id = w.user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY distance_m, old_id, new_id) AS k FROM p WHERE distance_m <= 1800),
g AS (SELECT user_id, 0::BIGINT AS k, []::BIGINT[] AS olds, []::BIGINT[] AS news, NULL::BIGINT AS old_id, NULL::BIGINT AS new_id, NULL::DOUBLE AS distance_m FROM (SELECT DISTINCT user_id FROM r)
  UNION ALL SELECT g.user_id, r.k, CASE WHEN f THEN list_append(olds, r.old_id) ELSE olds END, CASE WHEN f THEN list_append(news, r.new_id) ELSE news END, CASE WHEN f THEN r.old_id END, CASE WHEN f THEN r.new_id END, CASE WHEN f THEN r.distance_m END
  FROM g JOIN r ON r.user_id = g.user_id AND r.k = g.k + 1, LATERAL (SELECT NOT list_contains(g.olds, r.old_id) AND NOT list_contains(g.news, r.new_id) AS f) l)
SELECT user_id, old_id, new_id, round(distance_m, 3) AS distance_m FROM g WHERE old_id IS NOT NULL""",
    "class_locks": f"""WITH {FX}, d AS (SELECT user_id, t // 86400 * 86400 AS day FROM fx GROUP BY 1, 2), g AS (SELECT user_id, day, unnest(range(day, day + 86400, 900)) AS t FROM d),
a AS (SELECT user_id, t // 900 * 900 AS t, median(lat) AS lat, median(lon) AS lon, sum(steps)::BIGINT AS steps FROM fx GROUP BY 1, 2),
o AS (SELECT g.user_id, g.day, g.t, a.lat, a.lon, a.steps, CASE WHEN a.lat IS NOT NULL THEN {{'lat': a.lat, 'lon': a.lon, 't': g.t}} END AS f FROM g LEFT JOIN a ON g.user_id = a.user_id AND g.t = a.t),
w AS (SELECT *, count(*) FILTER (steps >= 30) OVER m AS high, count(steps) OVER m AS told, arg_min(f, t) FILTER (f IS NOT NULL) OVER m AS x, arg_max(f, t) FILTER (f IS NOT NULL) OVER m AS y,
  arg_max(f, t) FILTER (f IS NOT NULL) OVER (PARTITION BY user_id, day ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, arg_min(f, t) FILTER (f IS NOT NULL) OVER (PARTITION BY user_id, day ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
  FROM o WINDOW m AS (PARTITION BY user_id, day ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
k AS (SELECT *, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS spread, CASE WHEN y.t > x.t THEN {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} / (y.t - x.t) * 3.6 WHEN n.t > p.t THEN {hav('p.lat', 'p.lon', 'n.lat', 'n.lon')} / (n.t - p.t) * 3.6 END AS kmh FROM w),
l AS (SELECT user_id, t, CASE WHEN high >= 3 THEN 'foot' WHEN high = 0 AND kmh > 12 THEN 'vehicle' WHEN high = 0 AND told > 0 AND spread < 80 THEN 'stationary' END AS lock FROM k) SELECT * FROM l WHERE lock IS NOT NULL""",
    "split_scores": f"""WITH {FX}, d AS (SELECT *, t // 86400 AS day FROM fx), g AS (SELECT *, lag(t) OVER w AS pt, t - lag(t) OVER w AS gap, row_number() OVER w - 1 AS n, avg(lat) OVER b AS clat, avg(lon) OVER b AS clon
  FROM d WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id, day ORDER BY t, event_id), b AS (PARTITION BY user_id, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, median(gap) OVER (PARTITION BY user_id, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM g),
e AS (SELECT m.user_id, m.pt AS start_ts, m.t AS end_ts, m.gap, m.n, any_value(m.med) AS med, coalesce(sum(x.steps), 0)::BIGINT AS steps, count(x.bpm) AS beats, avg(x.bpm) AS bpm, any_value({hav('m.clat', 'm.clon', 'm.lat', 'm.lon')}) AS away
  FROM m LEFT JOIN d x ON x.user_id = m.user_id AND x.day = m.day AND x.t > m.pt AND x.t < m.t WHERE m.gap >= 900 GROUP BY m.user_id, m.pt, m.t, m.gap, m.n, m.event_id),
s AS (SELECT *, steps / (gap / 60.0::DOUBLE) AS pace FROM e), p AS (SELECT *, CASE WHEN pace > 20 THEN 3.5 WHEN pace > 8 THEN 2.0 WHEN pace > 3 THEN 0.5 WHEN pace > 1 THEN -0.5 ELSE -2.0 END::DOUBLE AS moved FROM s)
SELECT user_id, start_ts, end_ts, n AS fixes, steps, beats, round(bpm, 4) AS bpm, round(med, 1) AS median_gap_s, round(moved + CASE WHEN n >= 5 AND moved > 0 AND med > 0 THEN CASE WHEN gap / med > 50 THEN 1.0 WHEN gap / med > 10 THEN 0.5 ELSE 0 END ELSE 0 END
  + CASE WHEN beats >= 3 THEN CASE WHEN bpm > 110 THEN 0.8 WHEN bpm > 95 THEN 0.3 WHEN bpm < 75 THEN -0.5 ELSE 0 END ELSE 0 END + CASE WHEN away < 20 THEN -0.5 ELSE 0 END, 4) AS nats FROM p""",
    "trailing_600s": f"""WITH {FX}, h AS (SELECT *, lag(t) OVER w AS pt, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS hop_m FROM fx WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
p AS (SELECT a.event_id, any_value(a.t) AS t, any_value(a.lat) AS lat, any_value(a.lon) AS lon, arg_min(b.lat, (b.t, b.event_id)) AS flat, arg_min(b.lon, (b.t, b.event_id)) AS flon, min(b.t) AS ft, coalesce(sum(b.hop_m) FILTER (b.pt >= a.t - 600), 0) AS path_m
  FROM h a JOIN h b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 600 AND a.t GROUP BY a.event_id),
q AS (SELECT event_id, t, ft, path_m, {hav('flat', 'flon', 'lat', 'lon')} AS net_m FROM p)
SELECT event_id, round(path_m, 3) AS path_m, round(net_m, 3) AS net_m, round(CASE WHEN t > ft THEN net_m / (t - ft) * 3.6 END, 3) AS effective_kmh, round(CASE WHEN path_m > 0 THEN least(1.0, net_m / path_m) END, 6) AS straightness FROM q""",
    "state_diff": f"""WITH {FX}, {SPAN}, a AS (SELECT user_id, start_ts, end_ts, event_type AS mode, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, end_ts) AS ix FROM span),
b AS (SELECT * REPLACE (CASE WHEN start_ts % 7 = 0 THEN 'other' ELSE mode END AS mode) FROM a)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.ix, b.ix) AS ix, CASE WHEN b.ix IS NULL THEN 'only_a' WHEN a.ix IS NULL THEN 'only_b' ELSE 'changed' END AS kind
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.ix = b.ix WHERE a.ix IS NULL OR b.ix IS NULL OR a.mode <> b.mode""",
    "dwell_continuation": f"""WITH {FX}, {SP}, {SPAN}, s AS (SELECT * FROM span JOIN sp ON spot = place_id),
l AS (SELECT user_id, arg_max(p_lat, (start_ts, event_id)) AS lat, arg_max(p_lon, (start_ts, event_id)) AS lon, arg_max(end_ts, (start_ts, event_id)) AS end_ts FROM s GROUP BY user_id),
k AS (SELECT user_id, place_id, any_value(p_lat) AS p_lat, any_value(p_lon) AS p_lon, count(DISTINCT start_ts // 86400) AS days, sum(end_ts - start_ts) AS dwell_s, count(*) AS visits FROM s GROUP BY user_id, place_id),
d AS (SELECT l.user_id, k.place_id, l.end_ts, dwell_s / visits AS tau, {hav('lat', 'lon', 'p_lat', 'p_lon')} AS m FROM l JOIN k ON l.user_id = k.user_id WHERE days >= 5)
SELECT user_id, place_id, end_ts::BIGINT AS end_ts, round(end_ts + tau * ln(2))::BIGINT AS until_ts FROM d WHERE m <= 120 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY m, place_id) = 1""",
    "feasibility": f"""WITH {FX}, {SP}, {SPAN}, {MODED}, n AS (SELECT user_id, start_ts, end_ts, CASE WHEN event_type = 'view' THEN 'walking' ELSE 'stationary' END AS mode, lat, lon, event_id % 40 AS avg_speed FROM m),
w AS (SELECT *, lead(start_ts) OVER o - end_ts AS gap, lead(mode) OVER o AS next_mode, {hav('lat', 'lon', 'lead(lat) OVER o', 'lead(lon) OVER o')} AS jump FROM n WINDOW o AS (PARTITION BY user_id ORDER BY start_ts, end_ts))
SELECT user_id, start_ts, 'too_fast' AS fault FROM w WHERE mode = 'walking' AND avg_speed > 15
UNION ALL SELECT user_id, start_ts, 'teleport' FROM w WHERE mode = 'stationary' AND next_mode = 'stationary' AND gap <= 60 AND jump > 500""",
    "stream_tumbling": "SELECT event_type, floor(epoch(ts))::BIGINT // 3600 * 3600 AS start_ts, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_session": """WITH m AS (SELECT user_id, ts, epoch(ts) AS e, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 14400 THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m) SELECT user_id, floor(min(e))::BIGINT AS start_ts, floor(max(e) + 14400)::BIGINT AS end_ts, count(*) AS n FROM i GROUP BY user_id, s""",
}
