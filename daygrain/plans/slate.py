"""Queries of the engine over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrain.functions import chance, geo, opening, text, times
from daygrain.operators import aggregates as agg
from daygrain.operators import biometrics as bio
from daygrain.operators import evaluation, joins, places, segments, series, states
from daygrain.plans.derived import FX, SP, SPAN, events, fixes, hav, spans, spots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- the flagship: activity states of each user's days


@query("""WITH b AS (SELECT user_id, floor(epoch(ts))::BIGINT // 3600 * 3600 AS bucket, avg(value) AS mean_value, count(*) AS n FROM events GROUP BY ALL),
l AS (SELECT *, bucket // 86400 AS day, CASE WHEN mean_value >= 245 THEN 'active' ELSE 'calm' END AS state FROM b),
c AS (SELECT *, CASE WHEN lag(state) OVER w IS DISTINCT FROM state OR bucket - lag(bucket) OVER w > 21600 THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY user_id, day ORDER BY bucket)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id, day ORDER BY bucket) AS island FROM c)
SELECT user_id, day, min(bucket) AS start_ts, max(bucket) + 3600 AS end_ts, state, sum(n)::BIGINT AS n, round(avg(mean_value), 6) AS mean_value FROM i GROUP BY user_id, day, island, state""")
def day_states_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What contiguous states a user's day had, and how long each lasted."""
    e = events(spark, sf_dir)
    b = e.groupBy("user_id", (F.floor(F.col("t") / 3600) * 3600).alias("bucket")).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))
    b = b.withColumn("day", F.floor(F.col("bucket") / 86_400)).withColumn("state", F.when(F.col("mean_value") >= 245, "active").otherwise("calm"))
    keys = ["user_id", "day"]
    i = series.islands(b, keys, ["bucket"], ["state"], series.since_previous("bucket", keys, ["bucket"]) > 21_600)
    out = i.groupBy(*keys, "island", "state").agg(F.min("bucket").alias("start_ts"), (F.max("bucket") + 3600).alias("end_ts"), F.sum("n").alias("n"), F.round(F.avg("mean_value"), 6).alias("mean_value"))
    return out.drop("island")


FLAGSHIP = day_states_flagship

# --- scans


@query("SELECT event_id, user_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-11").cast("timestamp_ntz")
    return e.where((F.col("ts") >= day[0]) & (F.col("ts") < day[1])).select("event_id", "user_id", "event_type", "value").orderBy("event_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(floor(epoch(ts))::BIGINT) AS t FROM events GROUP BY user_id")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("t").alias("t"))


@query("SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE ts > TIMESTAMP '2024-01-05' ORDER BY ts DESC, event_id DESC LIMIT 2000")
def tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 2000 rows after an instant: a report's limit."""
    e = events(spark, sf_dir).where(F.col("ts") > F.lit("2024-01-05").cast("timestamp_ntz"))
    return e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(2000).select("event_id", "user_id", "t")


@query(f"WITH {FX} SELECT event_id, user_id, accuracy FROM fx WHERE accuracy IS NULL OR accuracy <= 60")
def accuracy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixes(spark, sf_dir).where("accuracy is null or accuracy <= 60").select("event_id", "user_id", "accuracy")


@query("""SELECT user_id, count(*) AS n, min(floor(epoch(ts))::BIGINT) AS first_t FROM events
WHERE ts::DATE BETWEEN greatest(DATE '2024-01-04', DATE '2024-01-08') AND DATE '2024-01-20' GROUP BY user_id""")
def share_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a viewer sees who asks from the 4th and may look from the 8th to the 20th."""
    day = F.col("ts").cast("date")
    since = F.greatest(F.lit("2024-01-04").cast("date"), F.lit("2024-01-08").cast("date"))
    e = events(spark, sf_dir).where(day.between(since, F.lit("2024-01-20").cast("date")))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, round(coalesce(value, 0), 1) AS value_1 FROM events")
def json_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.coalesce("value", F.lit(0.0)), 1).alias("value_1"))


# --- aggregates


@query("""SELECT user_id, floor(epoch(ts))::BIGINT // 3600 * 3600 AS bucket, min(floor(epoch(ts))::BIGINT) AS first_ts, round(avg(value))::BIGINT AS mean, min(value) AS least, max(value) AS most,
round(stddev_pop(value), 6) AS std, count(value) AS n FROM events GROUP BY 1, 2""")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(agg.buckets(events(spark, sf_dir), ["user_id"], "t", "value", 3600), "std")


@query(f"""WITH {FX} SELECT event_type, round(avg(bpm), 6) AS bpm_mean, round(stddev_pop(bpm), 6) AS bpm_std, count(bpm) AS bpm_count, round(avg(steps), 6) AS steps_mean, round(stddev_pop(steps), 6) AS steps_std,
count(steps) AS steps_count, count(*) AS sample_count FROM fx GROUP BY event_type""")
def type_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(agg.signature(fixes(spark, sf_dir), ["event_type"], ["bpm", "steps"]), "bpm_mean", "bpm_std", "steps_mean", "steps_std")


@query(f"""WITH {FX}, c AS (SELECT *, CASE WHEN steps < 40 THEN 0 ELSE steps END AS cad FROM fx)
SELECT event_type AS mode, count(*) AS n, round(avg(bpm), 6) AS hr_mean, round(greatest(coalesce(stddev_samp(bpm), 0), 5.0), 6) AS hr_std, round(avg(speed_kmh), 6) AS speed_mean,
round(greatest(coalesce(stddev_samp(speed_kmh), 0), 1.0), 6) AS speed_std, round(least(0.99, greatest(0.01, avg((cad = 0)::INT))), 6) AS cadence_p0, round(avg(cad) FILTER (cad > 0), 6) AS cadence_mean,
round(greatest(coalesce(stddev_samp(cad) FILTER (cad > 0), 0), 5.0), 6) AS cadence_std, count(*) < 50 AS fallback FROM c GROUP BY 1""")
def emission_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).withColumn("cad", F.when(F.col("steps") < 40, 0).otherwise(F.col("steps")))
    out = agg.emission_fit(f, "event_type", "bpm", "speed_kmh", "cad")
    return six(out, "hr_mean", "hr_std", "speed_mean", "speed_std", "cadence_p0", "cadence_mean", "cadence_std")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("user_id", F.col("ts").cast("date").alias("date")).agg(F.avg("value").alias("v"))


_DAILY = "dl AS (SELECT user_id, ts::DATE AS date, avg(value) AS v FROM events GROUP BY 1, 2)"


@query(f"""WITH {_DAILY}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS rn FROM dl WHERE date <= DATE '2024-01-28' AND date > DATE '2024-01-28' - 28)
SELECT user_id, max(date)::VARCHAR AS latest_date, round(arg_max(v, date), 6) AS latest, round(avg(v) FILTER (rn > 1), 6) AS baseline_mean, round(stddev_pop(v) FILTER (rn > 1), 6) AS baseline_sd, count(v) FILTER (rn > 1) AS baseline_n FROM s GROUP BY user_id""")
def recovery_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(agg.latest_and_baseline(_daily(spark, sf_dir), ["user_id"], "date", "v", 28, F.lit("2024-01-28").cast("date")), "latest", "baseline_mean", "baseline_sd").withColumn("latest_date", F.col("latest_date").cast("string"))


@query(f"""WITH {_DAILY} SELECT user_id, date::VARCHAR AS date, round(v, 6) AS v, round(avg(v) OVER w, 6) AS baseline_mean, round(stddev_pop(v) OVER w, 6) AS baseline_sd, count(v) OVER w AS baseline_n
FROM dl WINDOW w AS (PARTITION BY user_id ORDER BY date RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)""")
def recovery_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(agg.baseline_history(_daily(spark, sf_dir), ["user_id"], "date", "v", 28), "v", "baseline_mean", "baseline_sd").withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {FX}, {SPAN}, a AS (SELECT user_id, unnest(range(start_ts, end_ts + 1, 1800)) AS x FROM span), h AS (SELECT user_id, ((x // 3600) % 24)::INT AS hour, count(*) AS n FROM a GROUP BY 1, 2)
SELECT user_id, hour, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM h""")
def hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return six(agg.hour_profile(spans(spark, sf_dir), ["user_id"]), "share")


@query(f"""WITH {FX}, {SPAN}, d AS (SELECT user_id, spot, start_ts // 86400 AS day, end_ts - start_ts AS s, start_ts FROM span),
st AS (SELECT user_id, spot, sum(s)::BIGINT AS dwell_s, count(*) AS visits, count(DISTINCT day) AS days, (max(start_ts) - min(start_ts)) // 86400 AS span_days, avg(((start_ts // 3600) % 24 >= 22 OR (start_ts // 3600) % 24 < 7)::INT) AS overnight,
avg(((day + 4) % 7 BETWEEN 1 AND 5 AND (start_ts // 3600) % 24 BETWEEN 9 AND 16)::INT) AS wd FROM d GROUP BY 1, 2)
SELECT user_id, spot, dwell_s, visits, days, CASE WHEN span_days >= 30 AND days >= 20 AND overnight >= 0.25 THEN 'home'
WHEN (span_days >= 28 AND days >= 10 AND wd >= 0.35 AND overnight < 0.1) OR (span_days BETWEEN 5 AND 21 AND days >= 5 AND wd >= 0.35 AND overnight < 0.1) THEN 'work'
WHEN span_days <= 21 AND overnight >= 0.15 THEN 'hotel' WHEN days >= 5 AND span_days >= 30 THEN 'frequent' WHEN days <= 2 THEN 'one-off' ELSE 'other' END AS label FROM st""")
def cluster_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour, day = F.floor(F.col("start_ts") / 3600) % 24, F.floor(F.col("start_ts") / 86_400)
    s = spans(spark, sf_dir).groupBy("user_id", "spot").agg(
        F.sum(F.col("end_ts") - F.col("start_ts")).alias("dwell_s"), F.count("*").alias("visits"), F.countDistinct(day).alias("days"), F.floor((F.max("start_ts") - F.min("start_ts")) / 86_400).alias("span_days"),
        F.avg(((hour >= 22) | (hour < 7)).cast("int")).alias("overnight"), F.avg((((day + 4) % 7).between(1, 5) & hour.between(9, 16)).cast("int")).alias("wd"),
    )
    return s.select("user_id", "spot", "dwell_s", "visits", "days", agg.cluster_label(F.col("span_days"), F.col("days"), F.col("overnight"), F.col("wd")).alias("label"))


@query(f"""WITH {FX}, {SP}, d AS (SELECT user_id, spot, {hav('p_lat', 'p_lon', 'lat', 'lon')} AS dist FROM fx JOIN sp ON spot = place_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, spot ORDER BY dist) AS k, count(*) OVER (PARTITION BY user_id, spot) AS n FROM d)
SELECT user_id, spot, n, round(max(dist) FILTER (k = greatest(1, ceil(0.9::DOUBLE * n))), 4) AS radius_m FROM r GROUP BY 1, 2, 3""")
def scatter_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest-rank 90th percentile of distances from a spot's centre."""
    c = spots(spark)
    f = fixes(spark, sf_dir).join(c, F.col("spot") == F.col("place_id"))
    d = geo.haversine(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    out = evaluation.distance_stats(f.withColumn("error_m", d), ["user_id", "spot"])
    return out.select("user_id", "spot", "n", F.round("p90_m", 4).alias("radius_m"))


@query(f"""WITH {FX}, v AS (SELECT user_id, event_type, sum(value) AS weight FROM fx GROUP BY 1, 2), s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, event_type) AS k FROM v)
SELECT user_id, event_type, round(weight, 4) AS weight, round(share, 6) AS share FROM s WHERE k = 1 AND ((weight >= 3000 AND share >= 0.25) OR event_type = 'signup')""")
def amenity_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.weighted_vote(fixes(spark, sf_dir), ["user_id"], "event_type", "value", 3000, 0.25, ("signup",))
    return out.withColumn("weight", F.round("weight", 4)).withColumn("share", F.round("share", 6))


@query(f"""WITH {FX}, {SPAN}, v AS (SELECT event_type AS subtype, CASE WHEN event_type IN ('click', 'view') THEN 'look' ELSE 'act' END AS category, (end_ts - start_ts) / 60.0 AS minutes, ((start_ts + (end_ts - start_ts) // 2) // 3600) % 24 AS hour FROM span)
SELECT subtype, category, CASE WHEN minutes < 10 THEN 0 WHEN minutes < 40 THEN 1 WHEN minutes < 150 THEN 2 ELSE 3 END AS dwell, hour, count(*)::DOUBLE AS mass FROM v GROUP BY ALL""")
def venue_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    mid = F.col("start_ts") + F.floor((F.col("end_ts") - F.col("start_ts")) / 2)
    category = F.when(F.col("event_type").isin("click", "view"), "look").otherwise("act")
    v = s.select(F.col("event_type").alias("subtype"), category.alias("category"), ((F.col("end_ts") - F.col("start_ts")) / 60).alias("minutes"), (F.floor(mid / 3600) % 24).alias("hour"), F.lit(1.0).alias("weight"))
    return places.venue_priors(v)


@query(f"""WITH {FX}, m AS (SELECT user_id, t // 86400 AS day, spot, count(*) AS n, max(t) AS last FROM fx GROUP BY 1, 2, 3)
SELECT user_id, day, sum(n)::BIGINT AS minutes, arg_max(spot, n * 1000 - spot) AS dominant_place, round(max(n) / sum(n), 6) AS dominant_share, arg_max(spot, last) AS end_place, 0.95::DOUBLE AS end_posterior FROM m GROUP BY 1, 2""")
def presence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86_400))
    return six(agg.presence(f, ["user_id", "day"], "spot", "t"), "dominant_share")


@query("""SELECT 'events' AS table_name, count(*) AS n, min(ts::DATE)::VARCHAR AS first_day, max(ts::DATE)::VARCHAR AS last_day FROM events UNION ALL
SELECT 'orders', count(*), min(o_orderdate::DATE)::VARCHAR, max(o_orderdate::DATE)::VARCHAR FROM orders UNION ALL SELECT 'lineitem', count(*), min(l_shipdate::DATE)::VARCHAR, max(l_shipdate::DATE)::VARCHAR FROM lineitem""")
def table_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    day = lambda c: F.col(c).cast("date").cast("string")
    return agg.audit({"events": (read("events"), day("ts")), "orders": (read("orders"), day("o_orderdate")), "lineitem": (read("lineitem"), day("l_shipdate"))})


@query("SELECT event_type, count(*) AS total, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_value FROM events GROUP BY 1 HAVING count(*) >= 10 ORDER BY total DESC, event_type LIMIT 40")
def json_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.json_coverage(events(spark, sf_dir), "event_type", "props", "$.k", 10, 40)


@query("""SELECT user_id, round(avg(value) FILTER (ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-10'), 6) AS mean_1, count(value) FILTER (ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-10') AS n_1,
round(avg(value) FILTER (ts::DATE BETWEEN DATE '2024-01-11' AND DATE '2024-01-20'), 6) AS mean_2, count(value) FILTER (ts::DATE BETWEEN DATE '2024-01-11' AND DATE '2024-01-20') AS n_2,
round(avg(value) FILTER (ts::DATE BETWEEN DATE '2024-01-11' AND DATE '2024-01-20') - avg(value) FILTER (ts::DATE BETWEEN DATE '2024-01-01' AND DATE '2024-01-10'), 6) AS change FROM events GROUP BY 1""")
def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.period_comparison(events(spark, sf_dir), ["user_id"], F.col("ts").cast("date"), "value", ("2024-01-01", "2024-01-10"), ("2024-01-11", "2024-01-20"))
    return six(out, "mean_1", "mean_2", "change")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, max(floor(epoch(ts))::BIGINT) AS last_t FROM events GROUP BY 1")
def ops_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.max("t").alias("last_t"))


@query(f"""WITH {FX}, d AS (SELECT user_id, event_type, event_id, abs(((event_id * 13) % 97) - 40.0::DOUBLE) AS rail_m, abs(((event_id * 29) % 89) - 35.0::DOUBLE) AS road_m FROM fx)
SELECT user_id, event_type, CASE WHEN count(*) >= 3 THEN round(avg((road_m < rail_m)::INT), 6) END AS road_share, count(*) AS n FROM d GROUP BY 1, 2""")
def road_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = lambda p, q, z: F.abs((F.col("event_id") * p) % q - z).cast("double")
    f = fixes(spark, sf_dir).select("user_id", "event_type", far(13, 97, 40).alias("rail_m"), far(29, 89, 35).alias("road_m"))
    return six(agg.road_share(f, ["user_id", "event_type"]), "road_share")


# --- windows and sequences


@query(f"""WITH {FX}, m AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR t - lag(t) OVER w > 86400 THEN 1 ELSE 0 END AS new FROM fx WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island FROM m)
SELECT user_id, island::BIGINT AS island, event_type, min(t) AS start_ts, max(t) AS end_ts, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, order = ["user_id"], ["t", "event_id"]
    i = series.islands(fixes(spark, sf_dir), keys, order, ["event_type"], series.since_previous("t", keys, order) > 86_400)
    return i.groupBy("user_id", "island", "event_type").agg(F.min("t").alias("start_ts"), F.max("t").alias("end_ts"), F.count("*").alias("n"))


@query(f"""WITH {FX}, m AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 14400 THEN 0 ELSE 1 END AS new FROM fx),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM m) SELECT user_id, session::BIGINT AS session, min(t) AS start_ts, max(t) AS end_ts, count(*) AS n FROM i GROUP BY 1, 2""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.sessions(fixes(spark, sf_dir), ["user_id"], "t", "event_id", 14_400)


@query(f"""WITH {FX}, o AS (SELECT user_id, t, event_id, (bpm // 30)::BIGINT AS level, row_number() OVER (PARTITION BY user_id, t ORDER BY event_id) AS k FROM fx),
l AS (SELECT *, lag(level) OVER w AS a, lead(level) OVER w AS b, lead(t) OVER w AS nt, row_number() OVER w AS rn FROM o WHERE k = 1 WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, level FROM l WHERE rn = 1 OR nt IS NULL OR a IS DISTINCT FROM level OR b IS DISTINCT FROM level""")
def run_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).select("user_id", "t", "event_id", F.floor(F.col("bpm") / 30).alias("level"))
    return series.run_ends(f, ["user_id"], "t", "event_id", "level").select("user_id", "t", "level")


@query(f"""WITH {FX}, o AS (SELECT user_id, t, event_id, (bpm // 30)::BIGINT AS level, row_number() OVER (PARTITION BY user_id, t ORDER BY event_id DESC) AS k FROM fx),
l AS (SELECT *, lag(level) OVER w AS a, row_number() OVER w AS rn FROM o WHERE k = 1 WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, t, level FROM l WHERE rn = 1 OR a IS DISTINCT FROM level""")
def drop_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).select("user_id", "t", "event_id", F.floor(F.col("bpm") / 30).alias("level"))
    return series.drop_unchanged(f, ["user_id"], "t", "event_id", "level").select("user_id", "t", "level")


@query(f"""WITH {FX}, h AS (SELECT *, t - lag(t) OVER w AS gap_s, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS hop_m FROM fx WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, gap_s, round(hop_m, 3) AS hop_m, round(CASE WHEN gap_s > 0 THEN hop_m / gap_s * 3.6 END, 3) AS hop_kmh FROM h""")
def hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = series.hops(fixes(spark, sf_dir), ["user_id"], ["t", "event_id"])
    return h.select("event_id", "gap_s", F.round("hop_m", 3).alias("hop_m"), F.round("hop_kmh", 3).alias("hop_kmh"))


@query(f"""WITH {FX}, h AS (SELECT *, lag(t) OVER w AS pt, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS hop_m FROM fx WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
p AS (SELECT a.event_id, any_value(a.t) AS t, any_value(a.lat) AS lat, any_value(a.lon) AS lon, arg_min(b.lat, (b.t, b.event_id)) AS flat, arg_min(b.lon, (b.t, b.event_id)) AS flon, min(b.t) AS ft, coalesce(sum(b.hop_m) FILTER (b.pt >= a.t - 86400), 0) AS path_m
  FROM h a JOIN h b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 86400 AND a.t GROUP BY a.event_id)
SELECT event_id, round(path_m, 3) AS path_m, round({hav('flat', 'flon', 'lat', 'lon')}, 3) AS net_m FROM p""")
def trailing_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and net displacement over the trailing span; the driver's data are sparse, so it is a day here and 600 s in the stream."""
    h = series.trailing(fixes(spark, sf_dir), ["user_id"], ["t", "event_id"], 86_400)
    return h.select("event_id", F.round("path_m", 3).alias("path_m"), F.round("net_m", 3).alias("net_m"))


@query(f"""WITH {FX}, v AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN bpm END AS hr FROM fx)
SELECT event_id, last_value(hr IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev_hr,
first_value(hr IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_hr FROM v""")
def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).withColumn("hr", F.when(F.col("event_id") % 3 == 0, F.col("bpm")))
    return series.filled(f, ["user_id"], ["t", "event_id"], "hr").select("event_id", "prev_hr", "next_hr")


@query(f"""WITH {FX}, g AS (SELECT user_id, min(t) // 3600 * 3600 AS a, max(t) AS b FROM fx GROUP BY 1), s AS (SELECT user_id, unnest(range(a, b, 3600)) AS t FROM g), k AS (SELECT DISTINCT user_id, t // 3600 * 3600 AS t FROM fx),
m AS (SELECT s.user_id, s.t, k.t IS NOT NULL AS has FROM s LEFT JOIN k ON s.user_id = k.user_id AND s.t = k.t),
l AS (SELECT *, max(CASE WHEN has THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m),
b AS (SELECT *, max(CASE WHEN has AND t - seen >= 14400 THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM l)
SELECT user_id, t, has, CASE WHEN has THEN t - back END AS reacquire_s FROM b""")
def reacquire(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    grid = series.spine(f.groupBy("user_id").agg((F.floor(F.min("t") / 3600) * 3600).alias("a"), F.max("t").alias("b")), "a", "b", 3600)
    seen = f.select("user_id", (F.floor(F.col("t") / 3600) * 3600).alias("t")).distinct().withColumn("has", F.lit(True))
    g = grid.select("user_id", "t").join(seen, ["user_id", "t"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    return series.reacquire_age(g, ["user_id"], "t", "has", 14_400)


@query(f"""WITH {FX}, m AS (SELECT a.event_id, any_value(a.lat) AS lat, any_value(a.lon) AS lon, count(*) AS n, median(b.lat) AS mlat, median(b.lon) AS mlon FROM fx a JOIN fx b ON a.user_id = b.user_id AND b.t BETWEEN a.t - 172800 AND a.t + 172800 GROUP BY a.event_id)
SELECT event_id FROM m WHERE n < 5 OR NOT {hav('mlat', 'mlon', 'lat', 'lon')} > 4000""")
def drop_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.drop_outliers(fixes(spark, sf_dir), ["user_id"], span_s=172_800, far_m=4000.0).select("event_id")


@query(f"""WITH {FX}, b AS (SELECT event_id, user_id, t, ((degrees(atan2(sin(radians(lon) - radians(plon)) * cos(radians(lat)), cos(radians(plat)) * sin(radians(lat)) - sin(radians(plat)) * cos(radians(lat)) * cos(radians(lon) - radians(plon)))) % 360) + 360) % 360 AS head
  FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM fx WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)))
SELECT event_id, round(head, 3) AS head, round(least(abs(head - lag(head) OVER w), 360 - abs(head - lag(head) OVER w)), 3) AS turn FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    f = fixes(spark, sf_dir).withColumn("head", geo.bearing(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    return f.select("event_id", F.round("head", 3).alias("head"), F.round(geo.turn(F.col("head"), F.lag("head").over(w)), 3).alias("turn"))


# --- joins


@query(f"""WITH {FX}, o AS (SELECT o_custkey % 150 AS user_id, (floor(epoch(o_orderdate))::BIGINT % 2592000) + 1704067200 AS t, o_orderkey FROM orders), u AS (SELECT user_id, t, arg_min(o_orderkey, o_orderkey) AS lo, max(o_orderkey) AS hi FROM o GROUP BY 1, 2)
SELECT f.event_id, a.t AS asof_t, a.hi AS asof_o_orderkey FROM fx f ASOF LEFT JOIN u a ON f.user_id = a.user_id AND f.t >= a.t""")
def asof_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fix with the last order at or before it; of orders of one instant the one with the largest key."""
    return joins.as_of(fixes(spark, sf_dir).select("event_id", "user_id", "t"), _orders(spark, sf_dir), ["user_id"], "t", ["o_orderkey"], "o_orderkey").select("event_id", "asof_t", "asof_o_orderkey")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    t = F.pmod(times.epoch(F.col("o_orderdate")), F.lit(2_592_000)) + 1_704_067_200
    return o.select((F.col("o_custkey") % 150).alias("user_id"), t.alias("t"), "o_orderkey")


@query("""WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events), o AS (SELECT o_custkey % 150 AS user_id, (floor(epoch(o_orderdate))::BIGINT % 2592000) + 1704067200 AS t FROM orders), u AS (SELECT DISTINCT user_id, t FROM o),
p AS (SELECT e.event_id, e.t, u.t AS ot, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(e.t - u.t), u.t) AS k FROM e JOIN u ON e.user_id = u.user_id AND abs(e.t - u.t) <= 21600)
SELECT e.event_id, p.ot AS near_t FROM e LEFT JOIN p ON e.event_id = p.event_id AND k = 1""")
def nearest_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return joins.nearest_in_time(fixes(spark, sf_dir).select("event_id", "user_id", "t"), o, ["user_id"], "t", ["o_orderkey"], 21_600, "o_orderkey").select("event_id", "near_t")


@query(f"""WITH {FX}, {SPAN}, hr AS (SELECT user_id, t, bpm FROM fx)
SELECT s.event_id, round(avg(bpm), 1) AS hr_mean, min(bpm) AS hr_min, max(bpm) AS hr_max, round(stddev_pop(bpm), 1) AS hr_std FROM span s LEFT JOIN hr ON s.user_id = hr.user_id AND hr.t BETWEEN s.start_ts AND s.end_ts GROUP BY 1""")
def interval_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rates of each span, both ends included."""
    s = spans(spark, sf_dir)
    hr = fixes(spark, sf_dir).select("user_id", "t", "bpm")
    p = joins.in_interval(hr, s, ["user_id"], how="left")
    return p.groupBy("event_id").agg(F.round(F.avg("bpm"), 1).alias("hr_mean"), F.min("bpm").alias("hr_min"), F.max("bpm").alias("hr_max"), F.round(F.stddev_pop("bpm"), 1).alias("hr_std"))


@query(f"""WITH {FX}, {SPAN}, z AS (SELECT DISTINCT user_id, start_ts // 86400 * 86400 - 7200 AS start_ts, start_ts // 86400 * 86400 + 21600 AS end_ts FROM span)
SELECT s.user_id, s.spot, sum(least(s.end_ts, z.end_ts) - greatest(s.start_ts, z.start_ts))::BIGINT AS sleep_s FROM span s JOIN z ON s.user_id = z.user_id AND s.start_ts < z.end_ts AND z.start_ts < s.end_ts GROUP BY 1, 2""")
def overlap_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of sleep (22 to 6) at each spot."""
    s = spans(spark, sf_dir)
    night = F.floor(F.col("start_ts") / 86_400) * 86_400
    z = s.select("user_id", (night - 7200).alias("start_ts"), (night + 21_600).alias("end_ts")).distinct()
    return joins.overlapping(s, z, ["user_id"]).groupBy("user_id", "spot").agg(F.sum("overlap_s").alias("sleep_s"))


@query(f"""WITH {FX}, a AS (SELECT user_id, t // 3600 AS h, round(avg(bpm), 6) AS bpm FROM fx WHERE event_type <> 'purchase' GROUP BY 1, 2), b AS (SELECT user_id, t // 3600 AS h, sum(steps)::BIGINT AS steps FROM fx WHERE event_type <> 'click' GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.h, b.h) AS h, bpm, coalesce(steps, 0) AS cadence FROM a FULL JOIN b ON a.user_id = b.user_id AND a.h = b.h""")
def grid_full_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of time from two streams, told apart by the type of event; missing cadence counts as 0."""
    f = fixes(spark, sf_dir).withColumn("h", F.floor(F.col("t") / 3600))
    a = f.where("event_type <> 'purchase'").groupBy("user_id", "h").agg(F.round(F.avg("bpm"), 6).alias("bpm"))
    b = f.where("event_type <> 'click'").groupBy("user_id", "h").agg(F.sum("steps").alias("steps"))
    return a.join(b, ["user_id", "h"], "full").select("user_id", "h", "bpm", F.coalesce("steps", F.lit(0)).alias("cadence"))


@query(f"""WITH {FX}, {SP}, p AS (SELECT event_id, place_id, {hav('lat', 'lon', 'p_lat', 'p_lon')} AS d FROM fx, sp), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, place_id) AS rank FROM p WHERE d <= 1200)
SELECT event_id, place_id, rank, round(d, 3) AS distance_m FROM r WHERE rank <= 2""")
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two nearest places within 1200 m of each fix."""
    pairs = joins.within_radius(fixes(spark, sf_dir).select("event_id", "lat", "lon"), spots(spark), 1200.0)
    return joins.nearest_k(pairs, ["event_id"], 2, "place_id").select("event_id", "place_id", "rank", F.round("distance_m", 3).alias("distance_m"))


@query(f"""WITH {FX}, {SP}, p AS (SELECT event_id, place_id, p_lat, p_lon, {hav('lat', 'lon', 'p_lat', 'p_lon')} AS d FROM fx, sp), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, place_id) AS k FROM p WHERE d <= 150),
b AS (SELECT event_id, max(d) FILTER (k = 1) AS d1, max(d) FILTER (k = 2) AS d2, max(place_id) FILTER (k = 1) AS id FROM r GROUP BY 1)
SELECT f.event_id, CASE WHEN d1 <= 75 AND accuracy >= 30 AND (d2 IS NULL OR d2 >= 2 * d1) THEN id END AS snapped_place FROM fx f LEFT JOIN b USING (event_id)""")
def snap_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir).select("event_id", "lat", "lon", "accuracy")
    return joins.snap(f, spots(spark).select("place_id", "p_lat", "p_lon"), ["event_id"]).select("event_id", "snapped_place")


@query(f"""WITH {FX}, {SP}, p AS (SELECT event_id, place_id, radius_m, days::DOUBLE AS days, steps, bpm, {hav('lat', 'lon', 'p_lat', 'p_lon')} AS d FROM fx, sp), q AS (SELECT *, 1 / (1 + exp(-(4 - 0.08 * (steps / 60.0::DOUBLE) - 0.06 * greatest(0.0, bpm - 70.0)))) AS b,
  1 - exp(-greatest(0.0, days - 1) / 10) AS e FROM p WHERE d <= 1000),
s AS (SELECT *, -(d * d) / (2 * pow(greatest(radius_m, 40 + 60 * e), 2)) + ln(days + 1) + CASE WHEN d <= 110 THEN ln(1 + days) * b ELSE 0 END AS score,
  d <= least(3 * greatest(radius_m, 40 + 60 * e) * CASE WHEN d <= 110 THEN least(2.0, 1 + ln(1 + days) * b / 10) ELSE 1.0 END, 90 + 910 * e) AS ok FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, d, place_id) AS k FROM s WHERE ok AND score >= -8) SELECT event_id, place_id, round(score, 6) AS score FROM r WHERE k = 1""")
def place_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place of each fix, by distance, days and what heart and steps say."""
    f = fixes(spark, sf_dir).select("event_id", "lat", "lon", bio.coherence(F.col("steps") / 60, F.col("bpm").cast("double")).alias("coherence"))
    pairs = joins.within_radius(f, spots(spark), 1000.0).withColumn("profile", F.lit(None).cast("array<double>")).withColumn("weights", F.array(F.lit(1.0)))
    return places.best_place(pairs, ["event_id"]).select("event_id", "place_id", F.round("score", 6).alias("score"))


@query(f"""WITH {FX}, e AS (SELECT i AS way_id, 51.5::DOUBLE + i * 0.01::DOUBLE AS lat1, -0.1::DOUBLE + i * 0.015::DOUBLE AS lon1, 51.5::DOUBLE + (i + 1) * 0.01::DOUBLE AS lat2, -0.1::DOUBLE + (i + 1) * 0.015::DOUBLE AS lon2 FROM range(11) r(i)),
k AS (SELECT event_id, way_id, cos(radians(lat)) * 111320.0::DOUBLE AS c, (lon1 - lon) AS ax, (lat1 - lat) AS ay, (lon2 - lon) AS bx, (lat2 - lat) AS b_y FROM fx, e),
v AS (SELECT event_id, way_id, ax * c AS ax, ay * 111320.0 AS ay, bx * c AS bx, b_y * 111320.0 AS b_y FROM k), w AS (SELECT *, greatest(0.0, least(1.0, (-ax * (bx - ax) - ay * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS f FROM v),
d AS (SELECT event_id, way_id, sqrt(pow(ax + f * (bx - ax), 2) + pow(ay + f * (b_y - ay), 2)) AS d FROM w) SELECT event_id, way_id, round(d, 3) AS distance_m FROM d WHERE d <= 50""")
def near_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways within 50 m of each fix."""
    i = F.col("id")
    at = lambda k, z, s: (F.lit(z) + k * F.lit(s))
    e = spark.range(11).select(i.alias("way_id"), at(i, 51.5, 0.01).alias("lat1"), at(i, -0.1, 0.015).alias("lon1"), at(i + 1, 51.5, 0.01).alias("lat2"), at(i + 1, -0.1, 0.015).alias("lon2"))
    n = joins.near_lines(fixes(spark, sf_dir).select("event_id", "lat", "lon"), e, 50.0, ["event_id"])
    return n.select("event_id", "way_id", F.round("distance_m", 3).alias("distance_m"))


@query("""WITH d AS (SELECT o_custkey, o_orderdate, count(*) AS n, min(o_orderkey) AS keep FROM orders GROUP BY 1, 2) SELECT o.o_orderkey FROM orders o JOIN d ON o.o_custkey = d.o_custkey AND o.o_orderdate = d.o_orderdate WHERE o.o_orderkey = d.keep""")
def dedupe_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of orders with one customer and date the one with the smallest key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey")


@query("""WITH f AS (SELECT c_custkey, min(o_orderkey) AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT c_custkey, a.o_orderpriority AS first_priority, b.o_orderstatus AS last_status FROM f
LEFT JOIN orders a ON f.o = a.o_orderkey LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) b ON c_custkey = b.o_custkey""")
def two_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dimension in two roles: a customer's first and last order."""
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"))
    last = o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", "o_orderkey").alias("last_status"))
    out = c.join(first, c["c_custkey"] == first["o_custkey"], "left").drop("o_custkey")
    return out.join(last, out["c_custkey"] == last["o_custkey"], "left").select("c_custkey", "first_priority", "last_status")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey").distinct()
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("""WITH old AS (SELECT user_id, event_id % 50 AS k, min(value) AS v, NULL::VARCHAR AS tz FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2), new AS (SELECT user_id, event_id % 50 AS k, max(value) AS v, 'UTC' AS tz FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
SELECT coalesce(old.user_id, new.user_id) AS user_id, coalesce(old.k, new.k) AS k, coalesce(new.v, old.v) AS v, coalesce(old.tz, new.tz) AS tz FROM old FULL JOIN new ON old.user_id = new.user_id AND old.k = new.k""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the month put over the first: new values replace old ones; a time zone that is known stays."""
    from daygrain.sources.sinks import upserted

    e = events(spark, sf_dir).withColumn("k", F.col("event_id") % 50)
    mid = F.lit("2024-01-15").cast("timestamp_ntz")
    old = e.where(F.col("ts") < mid).groupBy("user_id", "k").agg(F.min("value").alias("v")).withColumn("tz", F.lit(None).cast("string"))
    new = e.where(F.col("ts") >= mid).groupBy("user_id", "k").agg(F.max("value").alias("v")).withColumn("tz", F.lit("UTC"))
    return upserted(old, new, ["user_id", "k"], first_writer=["tz"])


@query("SELECT user_id, ts::DATE::VARCHAR AS date, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def latest_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.groupBy("user_id", F.col("ts").cast("date").cast("string").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


# --- segments, states


@query(f"""WITH {FX}, w0 AS (SELECT *, t // 86400 AS win FROM fx), p AS (SELECT *, t - lag(t) OVER w AS dt, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS hop, speed_kmh - lag(speed_kmh) OVER w AS dv,
  avg(lat) OVER (PARTITION BY user_id, win) AS clat, avg(lon) OVER (PARTITION BY user_id, win) AS clon FROM w0 WINDOW w AS (PARTITION BY user_id, win ORDER BY t, event_id)),
a AS (SELECT user_id, win, min(t) AS start_ts, max(t) AS end_ts, median(speed_kmh) AS med, max(speed_kmh) AS most, coalesce(var_samp(speed_kmh), 0) AS var, sum(hop) AS path, arg_min(lat, (t, event_id)) AS la, arg_min(lon, (t, event_id)) AS lo,
  arg_max(lat, (t, event_id)) AS lb, arg_max(lon, (t, event_id)) AS l_b, count(*) FILTER (dt > 0 AND dv / dt > 5 / 3.6) AS burst, avg((speed_kmh < 1)::INT) AS stop, max({hav('clat', 'clon', 'lat', 'lon')}) AS rad, count(*) AS n FROM p GROUP BY 1, 2)
SELECT user_id, win, start_ts, end_ts, n, med, most, round(var, 4) AS var, burst, round(stop, 6) AS stop, round({hav('la', 'lo', 'lb', 'l_b')}, 3) AS net, round(rad, 3) AS rad, round(coalesce(least(1.0, {hav('la', 'lo', 'lb', 'l_b')} / nullif(path, 0)), 0), 5) AS lin FROM a WHERE n >= 2""")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = segments.window_features(fixes(spark, sf_dir).withColumn("win", F.floor(F.col("t") / 86_400)), ["user_id"], "event_id")
    return f.select("user_id", "win", "start_ts", "end_ts", "n", "med", "most", F.round("var", 4).alias("var"), "burst", F.round("stop", 6).alias("stop"), F.round("net", 3).alias("net"), F.round("rad", 3).alias("rad"), F.round("lin", 5).alias("lin"))


def _r(x: str, i: float, t: float) -> str:
    return f"exp(-0.5 * pow(({x} - {i}) / {t}::DOUBLE, 2))"


@query(f"""WITH v AS (SELECT event_id, value AS med, value * 1.5 AS most, (event_id % 50)::DOUBLE AS var, (event_id % 101) / 100.0::DOUBLE AS lin, (event_id % 7) / 2.0::DOUBLE AS hcr, (event_id % 4)::DOUBLE AS burst, (event_id % 11) / 10.0::DOUBLE AS stop, (event_id % 400)::DOUBLE AS net, (event_id % 90)::DOUBLE AS rad FROM events),
s AS (SELECT event_id, {_r('med', 0, 1.5)} * (1 + stop) * CASE WHEN rad < 30 THEN 3 ELSE 1 END * CASE WHEN rad < 15 THEN 3 ELSE 1 END * CASE WHEN net < 20 THEN 2 ELSE 1 END * CASE WHEN most > 20 AND net > 200 THEN 0.1 ELSE 1 END AS stationary,
{_r('med', 4, 3)} * {_r('lin', 0.5, 0.4)} * (1 + 0.5 * hcr) * CASE WHEN most > 15 THEN 0.1 ELSE 1 END * CASE WHEN rad < 30 THEN 0.1 ELSE 1 END * CASE WHEN net < 30 THEN 0.2 ELSE 1 END AS walking,
{_r('med', 18, 8)} * {_r('lin', 0.7, 0.3)} * {_r('var', 15, 20)} * CASE WHEN most > 50 THEN 0.1 ELSE 1 END AS cycling, {_r('med', 60, 35)} * (1 + 0.3 * burst) * {_r('lin', 0.7, 0.3)} * CASE WHEN med < 10 THEN 0.1 ELSE 1 END AS driving,
{_r('med', 120, 60)} * {_r('lin', 0.95, 0.1)} * {_r('var', 5, 15)} * {_r('hcr', 0.5, 2)} * CASE WHEN med < 30 THEN 0.1 ELSE 1 END AS train, {_r('med', 500, 300)} * {_r('lin', 0.99, 0.05)} * {_r('var', 2, 10)} * CASE WHEN med < 150 THEN 0.01 ELSE 1 END AS plane FROM v),
l AS (SELECT event_id, greatest(stationary, walking, cycling, driving, train, plane) AS top, stationary + walking + cycling + driving + train + plane AS total, CASE greatest(stationary, walking, cycling, driving, train, plane) WHEN stationary THEN 'stationary' WHEN walking THEN 'walking' WHEN cycling THEN 'cycling' WHEN driving THEN 'driving' WHEN train THEN 'train' ELSE 'plane' END AS mode FROM s)
SELECT event_id, mode, round(CASE WHEN total > 0 THEN top / total ELSE 0 END, 6) AS confidence FROM l""")
def mode_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    d = lambda m, by=1: ((k % m) / F.lit(float(by))).cast("double")
    v = events(spark, sf_dir).select(
        "event_id", F.col("value").alias("med"), (F.col("value") * 1.5).alias("most"), d(50).alias("var"), d(101, 100).alias("lin"), d(7, 2).alias("hcr"), d(4).alias("burst"), d(11, 10).alias("stop"), d(400).alias("net"), d(90).alias("rad")
    )
    return segments.score_windows(v).select("event_id", "mode", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {FX}, {SPAN}, s AS (SELECT user_id, start_ts, end_ts, event_type AS mode, row_number() OVER (PARTITION BY user_id ORDER BY start_ts, end_ts) AS rn FROM span WHERE event_type <> 'view'),
g AS (SELECT user_id, end_ts AS start_ts, lead(start_ts) OVER w AS end_ts FROM s WINDOW w AS (PARTITION BY user_id ORDER BY start_ts, end_ts)), l AS (SELECT * FROM g WHERE end_ts - start_ts >= 180),
u AS (SELECT user_id, t, arg_max(lat, lpad(event_id::VARCHAR, 20, '0')) AS hi_lat, arg_max(lon, event_id) AS hi_lon, arg_min(lat, event_id) AS lo_lat, arg_min(lon, event_id) AS lo_lon FROM fx GROUP BY 1, 2),
a AS (SELECT l.*, u.hi_lat AS alat, u.hi_lon AS alon FROM l ASOF LEFT JOIN u ON l.user_id = u.user_id AND l.start_ts >= u.t), b AS (SELECT a.*, u.lo_lat AS blat, u.lo_lon AS blon FROM a ASOF LEFT JOIN u ON a.user_id = u.user_id AND a.end_ts <= u.t),
d AS (SELECT *, {hav('alat', 'alon', 'blat', 'blon')} AS dm FROM b), v AS (SELECT *, dm / (end_ts - start_ts) * 3.6 AS kmh FROM d WHERE dm >= 200)
SELECT user_id, start_ts, end_ts, CASE WHEN kmh < 1.5 AND end_ts - start_ts >= 1800 THEN 'unknown' WHEN kmh < 7 THEN 'walking' WHEN kmh >= 120 THEN 'train' ELSE 'driving' END AS mode, round(kmh, 1) AS avg_speed FROM v""")
def transit_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir).where("event_type <> 'view'").withColumn("mode", F.col("event_type"))
    f = fixes(spark, sf_dir).withColumn("tie", F.lpad(F.col("event_id").cast("string"), 20, "0"))
    one = f.groupBy("user_id", "t").agg(F.max_by(F.struct("lat", "lon"), "tie").alias("hi"), F.min_by(F.struct("lat", "lon"), "tie").alias("lo"))
    # At one instant the later fix ends a stay and the earlier begins the next; instants are distinct after this.
    pick = one.select("user_id", "t", F.col("hi.lat").alias("lat"), F.col("hi.lon").alias("lon"))
    return segments.transit_gaps(s, pick, ["user_id"]).select("user_id", "start_ts", "end_ts", "mode", "avg_speed")


@query(f"""WITH {FX}, {SPAN}, n AS (SELECT DISTINCT user_id, start_ts // 86400 * 86400 AS start_ts, start_ts // 86400 * 86400 + 21600 AS end_ts FROM span), c AS (SELECT user_id, start_ts AS x FROM span UNION SELECT user_id, end_ts FROM span UNION SELECT user_id, start_ts FROM n UNION SELECT user_id, end_ts FROM n),
p AS (SELECT user_id, x AS a, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS b FROM c), m AS (SELECT p.user_id, p.a, p.b, CASE WHEN s.event_type IN ('click', 'view') THEN 'stationary' WHEN s.event_type IS NOT NULL THEN 'walking' END AS mode, s.spot, n.user_id IS NOT NULL AS z
  FROM p LEFT JOIN span s ON p.user_id = s.user_id AND s.start_ts <= (p.a + p.b) / 2.0 AND (p.a + p.b) / 2.0 < s.end_ts LEFT JOIN n ON p.user_id = n.user_id AND n.start_ts <= (p.a + p.b) / 2.0 AND (p.a + p.b) / 2.0 < n.end_ts WHERE p.b > p.a),
t AS (SELECT user_id, a, b, CASE WHEN mode IS NULL AND z THEN 'sleeping' WHEN z AND mode = 'stationary' AND spot = 0 THEN 'sleeping' ELSE mode END AS mode, CASE WHEN mode IS NULL THEN 0 ELSE spot END AS place, z AS asleep FROM m WHERE mode IS NOT NULL OR z),
k AS (SELECT *, CASE WHEN lag(mode) OVER w IS DISTINCT FROM mode OR lag(place) OVER w IS DISTINCT FROM place OR lag(asleep) OVER w IS DISTINCT FROM asleep OR a > lag(b) OVER w THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY user_id ORDER BY a, b)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, b) AS island FROM k) SELECT user_id, min(a) AS start_ts, max(b) AS end_ts, mode, place, asleep FROM i GROUP BY user_id, island, mode, place, asleep""")
def sleep_state_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of spans and nights (0 to 6, at spot 0)."""
    s = spans(spark, sf_dir)
    mode = F.when(F.col("event_type").isin("click", "view"), "stationary").otherwise("walking")
    night = F.floor(F.col("start_ts") / 86_400) * 86_400
    z = s.select("user_id", night.alias("start_ts"), (night + 21_600).alias("end_ts")).distinct().withColumn("place", F.lit(0).cast("long"))
    return states.day_states(s.select("user_id", "start_ts", "end_ts", mode.alias("mode"), F.col("spot").alias("place")), z, ["user_id"])


# --- decoder inputs and evaluation


@query(f"""WITH {FX}, d AS (SELECT user_id, t // 86400 * 86400 AS day FROM fx GROUP BY 1, 2), g AS (SELECT user_id, day, unnest(range(day, day + 86400, 3600)) AS t FROM d),
a AS (SELECT user_id, t // 3600 * 3600 AS t, median(lat) AS lat, median(lon) AS lon, avg(speed_kmh) AS speed, avg(bpm) AS hr, sum(steps)::BIGINT AS steps FROM fx GROUP BY 1, 2)
SELECT g.user_id, g.t, round(lat, 7) AS lat, round(lon, 7) AS lon, round(speed, 6) AS speed_kmh, round(hr, 6) AS hr, steps AS cadence FROM g LEFT JOIN a ON g.user_id = a.user_id AND g.t = a.t""")
def observation_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense grid of a day's observations; no row and zero stay apart."""
    from daygrain.operators.hsmm import observations

    f = fixes(spark, sf_dir).withColumn("day_start", F.floor(F.col("t") / 86_400) * 86_400)
    out = observations(f, ["user_id"], 3600)
    return out.select("user_id", "t", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("speed_kmh", 6).alias("speed_kmh"), F.round("hr", 6).alias("hr"), "cadence")


def _ln(x: str, m: float, s: float) -> str:
    return f"(-0.5 * pow(({x} - {m}) / {s}::DOUBLE, 2) - ln({s}::DOUBLE) - 0.5 * ln(2 * pi()))"


@query(f"""WITH {FX} SELECT event_id, round(ln(0.7::DOUBLE) + {_ln('speed_kmh', 0, 2)} + {_ln('bpm', 70, 15)} + CASE WHEN steps = 0 THEN ln(0.99::DOUBLE) ELSE ln(0.01::DOUBLE) + {_ln('steps', 10, 20)} END, 6) AS stationary,
round(ln(0.1::DOUBLE) + {_ln('speed_kmh', 5, 2)} + {_ln('bpm', 100, 20)} + CASE WHEN steps = 0 THEN ln(0.05::DOUBLE) ELSE ln(0.95::DOUBLE) + {_ln('steps', 100, 25)} END, 6) AS walking,
round(ln(0.02::DOUBLE) + {_ln('speed_kmh', 40, 20)} + {_ln('bpm', 75, 15)} + CASE WHEN steps = 0 THEN ln(0.99::DOUBLE) ELSE ln(0.01::DOUBLE) + {_ln('steps', 5, 10)} END, 6) AS driving FROM fx""")
def emission_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from daygrain.operators.hsmm import mode_emission

    f = fixes(spark, sf_dir)
    told = [F.round(mode_emission(m, F.col("speed_kmh"), F.col("bpm"), F.col("steps")), 6).alias(m) for m in ("stationary", "walking", "driving")]
    return f.select("event_id", *told)


@query(f"""WITH {FX}, s AS (SELECT user_id, t, CASE WHEN event_type IN ('click', 'view') THEN 'stationary' ELSE 'walking' END AS mode, CASE WHEN spot % 2 = 0 THEN 'stationary' ELSE 'walking' END AS true_mode, event_id FROM fx)
SELECT true_mode, mode, count(*) AS minutes FROM (SELECT user_id, t // 60 AS m, arg_max(true_mode, (t, event_id)) AS true_mode, arg_max(mode, (t, event_id)) AS mode FROM s GROUP BY 1, 2) GROUP BY 1, 2""")
def score_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes by true and decoded mode."""
    f = fixes(spark, sf_dir).withColumn("m", F.floor(F.col("t") / 60))
    mode = F.when(F.col("event_type").isin("click", "view"), "stationary").otherwise("walking")
    true = F.when(F.col("spot") % 2 == 0, "stationary").otherwise("walking")
    one = f.groupBy("user_id", "m").agg(F.max_by(F.struct(mode.alias("mode"), true.alias("true_mode")), F.struct("t", "event_id")).alias("s"))
    s = one.select("user_id", (F.col("m") * 60).alias("start_ts"), (F.col("m") * 60 + 60).alias("end_ts"), "s.*")
    grid = s.select("user_id", F.col("start_ts").alias("t"))
    return evaluation.confusion(s.select("user_id", "start_ts", "end_ts", "mode"), s.select("user_id", "start_ts", "end_ts", F.col("true_mode").alias("mode")), ["user_id"], grid)


@query(f"""WITH {FX}, {SPAN}, r AS (SELECT * FROM span WHERE event_type = 'purchase'), tr AS (SELECT user_id, start_ts + 3600 AS start_ts, end_ts + 3600 AS end_ts FROM span WHERE event_type IN ('purchase', 'error')),
o AS (SELECT r.user_id, r.start_ts, r.end_ts, sum(least(r.end_ts, tr.end_ts) - greatest(r.start_ts, tr.start_ts)) AS s FROM r JOIN tr ON r.user_id = tr.user_id AND r.start_ts < tr.end_ts AND tr.start_ts < r.end_ts GROUP BY 1, 2, 3)
SELECT r.user_id, r.start_ts, r.end_ts FROM r LEFT JOIN o ON r.user_id = o.user_id AND r.start_ts = o.start_ts AND r.end_ts = o.end_ts WHERE coalesce(s, 0) * 2 <= r.end_ts - r.start_ts""")
def phantom_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    truth = s.where(F.col("event_type").isin("purchase", "error")).select("user_id", (F.col("start_ts") + 3600).alias("start_ts"), (F.col("end_ts") + 3600).alias("end_ts"))
    return evaluation.phantoms(s.where("event_type = 'purchase'").select("user_id", "start_ts", "end_ts"), truth, ["user_id"])


@query("""WITH k AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), w AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT w.user_id, w.n, coalesce(k.n, 0) AS most FROM w LEFT JOIN k USING (user_id) WHERE w.n > coalesce(k.n, 0)""")
def ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a ceiling is broken."""
    e = events(spark, sf_dir)
    mid = F.lit("2024-01-15").cast("timestamp_ntz")
    count = lambda on: e.where(on).groupBy("user_id").agg(F.count("*").alias("n"))
    return evaluation.ceiling_gate(count(F.col("ts") < mid), count(F.col("ts") >= mid), ["user_id"])


# --- scalar functions


@query(f"""WITH {FX} SELECT event_id, ((floor((t + lon / 15.0 * 3600) / 3600)::BIGINT % 24 + 24) % 24)::INT AS solar_hour, (((floor((t + lon / 15.0 * 3600) / 86400)::BIGINT + 4) % 7 + 7) % 7)::INT AS solar_weekday FROM fx""")
def solar_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fixes(spark, sf_dir)
    return f.select("event_id", times.solar_hour(F.col("t"), F.col("lon")).alias("solar_hour"), times.solar_weekday(F.col("t"), F.col("lon")).alias("solar_weekday"))


@query("""SELECT event_id, round(lgamma(1 + value / 10), 6) AS log_gamma, round(2 * ln(0.5::DOUBLE) + (2 - 1) * ln(value) - 0.5 * value - lgamma(2.0::DOUBLE), 6) AS gamma_pdf FROM events""")
def densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Below 0 the SQL's logarithm isn't a number, and so neither is the query's gamma_pdf."""
    e = events(spark, sf_dir)
    pdf = F.when(F.col("value") < 0, math.nan).otherwise(chance.gamma_pdf(F.col("value"), 2.0, 0.5))
    told = e.select("event_id", chance.log_gamma(1 + F.col("value") / 10).alias("log_gamma"), pdf.alias("gamma_pdf"))
    return told.select("event_id", *[chance.rounded(F.col(c), 6).alias(c) for c in ("log_gamma", "gamma_pdf")])


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'Stop ' || event_id % 7 END AS board, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'Stop ' || event_id % 5 END AS alight,
CASE WHEN event_id % 4 = 0 THEN 'Blue' END AS line FROM events""")
def station_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of journeys, put together and read again."""
    k = F.col("event_id")
    name = lambda m: F.concat(F.lit("Stop "), (k % m).cast("string"))
    label = F.when(k % 4 == 3, "somewhere").otherwise(text.pair_label(name(7), name(5), F.when(k % 4 == 0, "Blue")))
    p = events(spark, sf_dir).select("event_id", text.station_pair(label).alias("p"))
    return p.select("event_id", "p.board", "p.alight", "p.line")


@query("""SELECT event_id, ((floor(epoch(ts))::BIGINT // 60) % 1440 BETWEEN 540 AND 1049 AND (floor(epoch(ts))::BIGINT // 86400 + 3) % 7 <= 4) OR ((floor(epoch(ts))::BIGINT // 86400 + 3) % 7 = 5 AND (floor(epoch(ts))::BIGINT // 60) % 1440 >= 1320)
OR ((floor(epoch(ts))::BIGINT // 86400 + 3) % 7 = 6 AND (floor(epoch(ts))::BIGINT // 60) % 1440 < 120) AS is_open FROM events""")
def opening_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("week", opening.parsed(F.lit("Mo-Fr 9:00-17:30; Sa 22:00-2:00; PH off")))
    return e.select("event_id", opening.is_open(F.col("week"), F.floor(F.col("t") / 60)).alias("is_open"))
