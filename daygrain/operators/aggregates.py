"""Aggregations: buckets, signatures, emission fits, baselines, profiles, votes, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import geo


def buckets(df: DataFrame, keys: list[str], t: str, value: str, size_s: int) -> DataFrame:
    """Per key and bucket of time: start_ts (the first sample's), mean rounded to whole numbers, least, most, population deviation, n."""
    b = (F.floor(F.col(t) / size_s) * size_s).alias("bucket")
    v = F.col(value)
    return df.groupBy(*keys, b).agg(
        F.min(t).alias("first_ts"), F.round(F.avg(v)).cast("bigint").alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("std"), F.count(v).alias("n")
    )


def signature(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key, for each value its mean, population deviation and number of samples, and sample_count over all rows."""
    told = []
    for v in values:
        told += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"), F.count(v).alias(f"{v}_count")]
    return df.groupBy(*keys).agg(*told, F.count("*").alias("sample_count"))


def emission_fit(df: DataFrame, mode: str, hr: str, speed: str, cadence: str, floors: tuple[float, float, float] = (5.0, 1.0, 5.0), least: int = 50, p0: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Per mode Gaussians of heart rate and speed (sample deviation, not below the floors), and a zero-inflated one of cadence. A mode with fewer than
    `least` samples is a fallback."""
    std = lambda v, floor: F.greatest(F.coalesce(F.stddev_samp(v), F.lit(0.0)), F.lit(floor))
    moving = F.when(F.col(cadence) > 0, F.col(cadence))
    share = F.avg(F.when(F.col(cadence).isNotNull(), (F.col(cadence) == 0).cast("double")))
    return df.groupBy(F.col(mode).alias("mode")).agg(
        F.count("*").alias("n"), F.avg(hr).alias("hr_mean"), std(hr, floors[0]).alias("hr_std"), F.avg(speed).alias("speed_mean"), std(speed, floors[1]).alias("speed_std"),
        F.least(F.lit(p0[1]), F.greatest(F.lit(p0[0]), share)).alias("cadence_p0"), F.avg(moving).alias("cadence_mean"), std(moving, floors[2]).alias("cadence_std"),
        (F.count("*") < least).alias("fallback"),
    )


def latest_and_baseline(daily: DataFrame, keys: list[str], date: str, value: str, days: int, until: Column) -> DataFrame:
    """Per key the latest non-null value up to `until` within the trailing `days`, and mean, population deviation and number of the days before it."""
    seen = daily.where(F.col(value).isNotNull() & (F.col(date) <= until) & (F.col(date) > F.date_sub(until, days)))
    w = Window.partitionBy(*keys).orderBy(F.col(date).desc())
    ranked = seen.withColumn("__n", F.row_number().over(w))
    before = F.when(F.col("__n") > 1, F.col(value))
    return ranked.groupBy(*keys).agg(
        F.max(date).alias("latest_date"), F.max_by(value, date).alias("latest"), F.avg(before).alias("baseline_mean"), F.stddev_pop(before).alias("baseline_sd"), F.count(before).alias("baseline_n")
    )


def baseline_history(daily: DataFrame, keys: list[str], date: str, value: str, days: int) -> DataFrame:
    """For each day with a value the mean, population deviation and number of the `days` before it."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(-days, -1)
    out = daily.where(F.col(value).isNotNull()).withColumn("__day", day)
    return out.select(*keys, date, value, F.avg(value).over(w).alias("baseline_mean"), F.stddev_pop(value).over(w).alias("baseline_sd"), F.count(value).over(w).alias("baseline_n"))


def hour_profile(stays: DataFrame, keys: list[str], start: str = "start_ts", end: str = "end_ts", offset_s: Column | None = None, step_s: int = 1800) -> DataFrame:
    """Per key and local hour the share of half-hourly samples of its spans, ends included: hour, share. Hours without samples are absent."""
    at = F.explode(F.sequence(F.col(start), F.col(end), F.lit(step_s).cast("long"))).alias("__at")
    shift = offset_s if offset_s is not None else F.lit(0)
    hours = stays.where(F.col(start) <= F.col(end)).select(*keys, shift.alias("__shift"), at)
    hours = hours.withColumn("hour", F.pmod(F.floor((F.col("__at") + F.col("__shift")) / 3600), F.lit(24)).cast("int"))
    n = hours.groupBy(*keys, "hour").agg(F.count("*").alias("__n"))
    return n.withColumn("share", F.col("__n") / F.sum("__n").over(Window.partitionBy(*keys))).drop("__n")


def profile_array(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Profiles as arrays of 24 shares."""
    m = profile.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("hour", "share"))).alias("__m"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("__m", h), F.lit(0.0))).alias("profile"))


def cluster_stats(stays: DataFrame, keys: list[str], centre: DataFrame) -> DataFrame:
    """Per cluster: dwell_s, visits, days, first_ts, last_ts, radius_m (the nearest-rank 90th percentile of its stays' distances from the centre), overnight share
    (22 to 7 local) and weekday day share (9 to 17). stays: start_ts, end_ts, lat, lon, local_shift_s; centre: keys, c_lat, c_lon."""
    d = geo.haversine(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))
    s = stays.join(centre, keys).withColumn("__d", d).withColumn("__s", F.col("start_ts") + F.col("local_shift_s"))
    base = s.groupBy(*keys).agg(
        F.sum(F.col("end_ts") - F.col("start_ts")).alias("dwell_s"), F.count("*").alias("visits"), F.countDistinct(F.floor(F.col("__s") / 86_400)).alias("days"),
        F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY __d)").alias("radius_m"),
    )
    at = s.select(*keys, F.explode(F.sequence("__s", F.col("end_ts") + F.col("local_shift_s"), F.lit(1800).cast("long"))).alias("__at"))
    hour = F.pmod(F.floor(F.col("__at") / 3600), F.lit(24))
    weekday = F.pmod(F.floor(F.col("__at") / 86_400) + 4, F.lit(7)).between(1, 5)
    shares = at.groupBy(*keys).agg(F.avg(((hour >= 22) | (hour < 7)).cast("double")).alias("overnight"), F.avg((weekday & (hour >= 9) & (hour < 17)).cast("double")).alias("weekday_day"))
    return base.join(shares, keys)


def cluster_label(span_days: Column, days: Column, overnight: Column, weekday_day: Column) -> Column:
    """home, work, hotel, frequent, one-off or other."""
    work = (span_days >= 28) & (days >= 10) & (weekday_day >= 0.35) & (overnight < 0.1)
    stint = span_days.between(5, 21) & (days >= 5) & (weekday_day >= 0.35) & (overnight < 0.1)
    return (
        F.when((span_days >= 30) & (days >= 20) & (overnight >= 0.25), "home").when(work | stint, "work").when((span_days <= 21) & (overnight >= 0.15), "hotel")
        .when((days >= 5) & (span_days >= 30), "frequent").when(days <= 2, "one-off").otherwise("other")
    )


def weighted_vote(votes: DataFrame, keys: list[str], label: str, weight: str, least: float, least_share: float, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Per key the label with the largest sum of weights, if that is `least` or more and `least_share` of all; exempt labels need neither."""
    sums = votes.groupBy(*keys, label).agg(F.sum(weight).alias("weight"))
    total = Window.partitionBy(*keys)
    ranked = sums.withColumn("share", F.col("weight") / F.sum("weight").over(total))
    ranked = ranked.withColumn("__n", F.row_number().over(total.orderBy(F.col("weight").desc(), label)))
    ok = ((F.col("weight") >= least) & (F.col("share") >= least_share)) | F.col(label).isin(*exempt)
    return ranked.where((F.col("__n") == 1) & ok).select(*keys, label, "weight", "share")


def dwell_bucket(minutes: Column) -> Column:
    """0 below 10 minutes, 1 below 40, 2 below 150, 3 from there."""
    return F.when(minutes < 10, 0).when(minutes < 40, 1).when(minutes < 150, 2).otherwise(3)


def presence(minutes: DataFrame, keys: list[str], place: str, t: str, sure: float = 0.95) -> DataFrame:
    """Per key (a user's day): minutes with a place, the place with most of them and its share, the last place, and its posterior."""
    n = minutes.where(F.col(place).isNotNull()).groupBy(*keys, place).agg(F.count("*").alias("__n"), F.max(t).alias("__last"))
    order = F.struct(F.col("__n"), F.negative(F.col(place)))
    return n.groupBy(*keys).agg(
        F.sum("__n").alias("minutes"), F.max_by(place, order).alias("dominant_place"), (F.max("__n") / F.sum("__n")).alias("dominant_share"),
        F.max_by(place, "__last").alias("end_place"), F.lit(sure).alias("end_posterior"),
    )


def audit(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """Per table its number of rows, and the first and last date."""
    out = None
    for name, (df, day) in tables.items():
        one = df.agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day")).select(F.lit(name).alias("table_name"), "n", "first_day", "last_day")
        out = one if out is None else out.unionByName(one)
    return out


def json_coverage(df: DataFrame, by: str, json: str, path: str, least: int, most: int) -> DataFrame:
    """Groups of `least` rows or more, by how many: total, with_value; the `most` largest."""
    has = F.get_json_object(json, path).isNotNull()
    out = df.groupBy(by).agg(F.count("*").alias("total"), F.count_if(has).alias("with_value")).where(F.col("total") >= least)
    return out.orderBy(F.col("total").desc(), by).limit(most)


def period_comparison(df: DataFrame, keys: list[str], day: Column, value: str, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Means and numbers of a value in two periods of days, bounds included, and the difference of the means."""
    one, two = (F.when(day.between(*[F.lit(d).cast("date") for d in p]), F.col(value)) for p in (first, second))
    out = df.groupBy(*keys).agg(F.avg(one).alias("mean_1"), F.count(one).alias("n_1"), F.avg(two).alias("mean_2"), F.count(two).alias("n_2"))
    return out.withColumn("change", F.col("mean_2") - F.col("mean_1"))


def nearest_named(pairs: DataFrame, keys: list[str], name: str, tie: str, distance: str = "distance_m") -> DataFrame:
    """Of each key and name the nearest row."""
    w = Window.partitionBy(*keys, name).orderBy(distance, tie)
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def road_share(samples: DataFrame, keys: list[str], road: str = "road_m", rail: str = "rail_m", least: int = 3) -> DataFrame:
    """Per key the share of samples that lie nearer a road than a rail; null for fewer than `least` samples with a distance."""
    known = samples.where(F.col(road).isNotNull() | F.col(rail).isNotNull())
    nearer = (F.coalesce(F.col(road), F.lit(float("inf"))) < F.coalesce(F.col(rail), F.lit(float("inf")))).cast("double")
    return known.groupBy(*keys).agg(F.when(F.count("*") >= least, F.avg(nearer)).alias("road_share"), F.count("*").alias("n"))
