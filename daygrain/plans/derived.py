"""Tables that the slate derives from `events`: fixes with integer-made coordinates, places, spans. Each with the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrain.functions import times

#: Spots of the derived coordinates.
SPOTS = 12


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", times.epoch(F.col("ts")))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, t, spot, lat, lon, accuracy, steps, bpm, speed_kmh."""
    e = events(spark, sf_dir)
    hour = F.floor(F.col("t") / 3600) % 24
    e = e.withColumn("spot", (F.col("user_id") * 7 + hour * 3) % SPOTS)
    jit = lambda p: (F.col("event_id") * p) % 200 - 100
    return e.select(
        "event_id", "user_id", "event_type", "value", "t", "spot", (F.lit(51.5) + F.col("spot") * F.lit(0.01) + jit(7919) / F.lit(1e6)).alias("lat"),
        (F.lit(-0.1) + F.col("spot") * F.lit(0.015) + jit(104729) / F.lit(1e6)).alias("lon"), (5 + F.col("event_id") * 31 % 120).cast("double").alias("accuracy"),
        (F.col("event_id") % 130).alias("steps"), (55 + F.floor("value") % 90).alias("bpm"), ((F.col("event_id") * 37) % 140).cast("double").alias("speed_kmh"),
    )


FX = """fx AS (SELECT event_id, user_id, event_type, value, t, spot, 51.5::DOUBLE + spot * 0.01::DOUBLE + ((event_id * 7919) % 200 - 100) / 1e6::DOUBLE AS lat,
  -0.1::DOUBLE + spot * 0.015::DOUBLE + ((event_id * 104729) % 200 - 100) / 1e6::DOUBLE AS lon, (5 + event_id * 31 % 120)::DOUBLE AS accuracy, event_id % 130 AS steps,
  55 + floor(value)::BIGINT % 90 AS bpm, ((event_id * 37) % 140)::DOUBLE AS speed_kmh
  FROM (SELECT *, (user_id * 7 + ((t // 3600) % 24) * 3) % 12 AS spot FROM (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events)))"""


def spots(spark: SparkSession) -> DataFrame:
    """place_id, p_lat, p_lon, radius_m, days of the twelve spots and of one beside each that is seldom used."""
    s = spark.range(SPOTS).withColumnRenamed("id", "place_id")
    one = s.select("place_id", (F.lit(51.5) + F.col("place_id") * F.lit(0.01)).alias("p_lat"), (F.lit(-0.1) + F.col("place_id") * F.lit(0.015)).alias("p_lon"), F.lit(50.0).alias("radius_m"), (F.col("place_id") + 3).alias("days"))
    two = s.select((F.col("place_id") + 100).alias("place_id"), (F.lit(51.5) + F.col("place_id") * F.lit(0.01) + F.lit(0.0005)).alias("p_lat"), (F.lit(-0.1) + F.col("place_id") * F.lit(0.015)).alias("p_lon"), F.lit(30.0).alias("radius_m"), F.lit(1).cast("long").alias("days"))
    return one.unionByName(two)


SP = """sp AS (SELECT i AS place_id, 51.5::DOUBLE + i * 0.01::DOUBLE AS p_lat, -0.1::DOUBLE + i * 0.015::DOUBLE AS p_lon, 50.0::DOUBLE AS radius_m, i + 3 AS days FROM range(12) r(i)
  UNION ALL SELECT i + 100, 51.5::DOUBLE + i * 0.01::DOUBLE + 0.0005::DOUBLE, -0.1::DOUBLE + i * 0.015::DOUBLE, 30.0::DOUBLE, 1 FROM range(12) r(i))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, start_ts, end_ts, event_type, spot: from each event of a user to the next, six hours at most."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    f = fixes(spark, sf_dir).withColumn("nxt", F.lead("t").over(w))
    end = F.least(F.col("t") + 21_600, F.coalesce("nxt", F.col("t") + 21_600))
    return f.select("user_id", F.col("t").alias("start_ts"), end.alias("end_ts"), "event_type", "spot", "event_id").where("end_ts > start_ts")


SPAN = """span AS (SELECT user_id, t AS start_ts, least(t + 21600, coalesce(nxt, t + 21600)) AS end_ts, event_type, spot, event_id
  FROM (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM fx) WHERE least(t + 21600, coalesce(nxt, t + 21600)) > t)"""

#: SQL for the great-circle distance of (a, b) and (c, d).
HAV = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"


def hav(a: str, b: str, c: str, d: str) -> str:
    return HAV.format(a=a, b=b, c=c, d=d)
