"""Heart rate, steps and sleep per segment, and the corrections that they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import chance
from daygrain.operators.joins import in_interval, overlapping

#: Cadence, in steps a minute, from which someone walks.
PEDESTRIAN_SPM = 60.0


def enrich(segments: DataFrame, hr: DataFrame, steps: DataFrame, sleep: DataFrame, on: list[str]) -> DataFrame:
    """Segments (on, start_ts, end_ts) with hr_mean, hr_min, hr_max, hr_std (one decimal), steps (null without a row), cadence, peak_cadence,
    walking_minutes, sleep_share. hr: t, bpm; steps: t, steps a minute; sleep: start_ts, end_ts."""
    key = [*on, "start_ts", "end_ts"]
    h = in_interval(hr.select(*on, "t", "bpm"), segments.select(*key), on).groupBy(*key)
    h = h.agg(F.round(F.avg("bpm"), 1).alias("hr_mean"), F.min("bpm").alias("hr_min"), F.max("bpm").alias("hr_max"), F.round(F.stddev_pop("bpm"), 1).alias("hr_std"))
    s = in_interval(steps.select(*on, "t", "steps"), segments.select(*key), on, closed=False).groupBy(*key)
    s = s.agg(F.sum("steps").alias("steps"), F.max("steps").alias("peak_cadence"), F.count_if(F.col("steps") >= PEDESTRIAN_SPM).alias("walking_minutes"))
    z = overlapping(segments.select(*key), sleep.select(*on, "start_ts", "end_ts"), on).groupBy(*key).agg(F.sum("overlap_s").alias("__asleep"))
    out = segments.join(h, key, "left").join(s, key, "left").join(z, key, "left")
    length = F.col("end_ts") - F.col("start_ts")
    out = out.withColumn("cadence", F.when(length < 30, 0.0).otherwise(F.col("steps") / (length / 60)))
    return out.withColumn("sleep_share", F.when(length > 0, F.least(F.lit(1.0), F.coalesce("__asleep", F.lit(0)) / length))).drop("__asleep")


def coherence(steps_per_min: Column, hr: Column) -> Column:
    """How well heart and steps fit a stay, 0 to 1; an unknown heart rate counts as 70."""
    return chance.logistic(4 - 0.08 * steps_per_min - 0.06 * F.greatest(F.lit(0.0), F.coalesce(hr, F.lit(70.0)) - 70))


def minute_mode(speed: Column, cadence: Column, hr: Column) -> Column:
    """The mode that a minute's speed, cadence and heart rate name; null outside all boxes."""
    still = F.coalesce(cadence, F.lit(0)) < 5
    return (
        F.when((speed < 1) & still, "stationary").when(cadence.between(80, 140) & speed.between(3, 7), "walking")
        .when((cadence < 5) & speed.between(12, 25) & hr.between(100, 170), "cycling")
        .when((cadence < 5) & (speed > 30) & (speed <= 80) & (F.coalesce(hr, F.lit(0)) < 95), "driving")
        .when((speed > 80) & (speed <= 330), "train").when(speed > 500, "plane")
    )


def cadence_to_drive(segments: DataFrame, steps: DataFrame, on: list[str]) -> DataFrame:
    """Walks of three minutes or more at 15 km/h or less with under 5 steps a minute become drives, where step rows after them (within half an hour)
    show that steps were recorded. segments: mode, avg_speed, cadence."""
    key = [*on, "start_ts", "end_ts"]
    after = segments.select(*key, (F.col("end_ts") + 1).alias("__from"), (F.col("end_ts") + 1800).alias("__to"))
    fresh = in_interval(steps.select(*on, "t"), after, on, start="__from", end="__to").select(*key).distinct().withColumn("__fresh", F.lit(True))
    ok = (F.col("end_ts") - F.col("start_ts") >= 180) & (F.col("mode") == "walking") & (F.col("avg_speed") <= 15) & F.col("__fresh") & (F.coalesce("cadence", F.lit(0.0)) < 5)
    ok = F.coalesce(ok, F.lit(False))
    out = segments.join(fresh, key, "left").withColumn("flipped", ok)
    return out.withColumn("mode", F.when(ok, "driving").otherwise(F.col("mode"))).drop("__fresh")


def jitter_to_stay(mode: Column, length_s: Column, linearity: Column, peak_cadence: Column, fresh: Column) -> Column:
    """A walk that goes nowhere without steps is a stay."""
    on = (mode == "walking") & (length_s >= 180) & (linearity < 0.35) & (F.coalesce(peak_cadence, F.lit(0)) < 20) & fresh
    return F.when(on, "stationary").otherwise(mode)


def cycling_gate(mode: Column, speed: Column, cadence: Column) -> Column:
    """Cycling stays at 12 to 35 km/h with under 20 steps a minute; faster it is a drive, else a walk."""
    keep = speed.between(12, 35) & (F.coalesce(cadence, F.lit(0)) < 20)
    return F.when(mode != "cycling", mode).when(keep, "cycling").when(speed > 35, "driving").otherwise("walking")


def physical_limits(mode: Column, average: Column, most: Column) -> Column:
    """A drive above 250 km/h is a train, a train above 400 on average a plane."""
    train = F.when((mode == "driving") & (most > 250), "train").otherwise(mode)
    return F.when((train == "train") & (average > 400), "plane").otherwise(train)


def walk_through(segments: DataFrame, on: list[str]) -> DataFrame:
    """Stays with a burst of steps and movement become walks: 3 to 45 minutes, 1 km/h or more, a peak of 80 steps or 3 walking minutes; not those of
    ten minutes or more within 80 m, nor those between stays at one place. segments: mode, avg_speed, peak_cadence, walking_minutes, extent_m, place."""
    w = Window.partitionBy(*on).orderBy("start_ts", "end_ts")
    length = F.col("end_ts") - F.col("start_ts")
    burst = (F.coalesce("peak_cadence", F.lit(0)) >= 80) | (F.coalesce("walking_minutes", F.lit(0)) >= 3)
    settled = (length >= 600) & (F.coalesce("extent_m", F.lit(1e9)) <= 80)
    inside = (F.lag("mode").over(w) == "stationary") & (F.lead("mode").over(w) == "stationary") & (F.lag("place").over(w) == F.lead("place").over(w))
    on_ = (F.col("mode") == "stationary") & length.between(180, 2700) & (F.col("avg_speed") >= 1) & burst & ~settled & ~F.coalesce(inside, F.lit(False))
    return segments.withColumn("mode", F.when(F.coalesce(on_, F.lit(False)), "walking").otherwise(F.col("mode")))


def signature_score(speed: Column, cadence: Column, hr: Column, s: str = "sig_") -> Column:
    """Log-likelihood of a segment's biometrics under a mode's signature (columns <s>hr_mean ...); deviations are 5, 5 and 2 at least, unknown values say nothing."""
    one = lambda x, v, floor: F.coalesce(chance.gaussian(x, F.col(f"{s}{v}_mean"), F.greatest(F.col(f"{s}{v}_std"), F.lit(floor))), F.lit(0.0))
    return one(hr, "hr", 5.0) + one(cadence, "cadence", 5.0) + one(speed, "speed", 2.0)


def hr_vetoed(hr: Column, mean: Column, std: Column) -> Column:
    return F.coalesce(F.abs(hr - mean) > 2 * F.greatest(std, F.lit(5.0)), F.lit(False))


def cadence_vetoed(cadence: Column, speed: Column, mean: Column, std: Column) -> Column:
    """Too many steps for a mode, at 15 km/h or less."""
    return F.coalesce((speed <= 15) & (cadence > F.greatest(mean + 2 * std, F.lit(30.0))), F.lit(False))


def relabel(segments: DataFrame, signatures: DataFrame, on: list[str], least: float = 4.0, margin: float = 3.0) -> DataFrame:
    """Segments with a margin below `margin` take the mode whose signature explains them better by `least` nats or more. signatures: on, sig_mode, sig_..."""
    key = [*on, "start_ts", "end_ts"]
    pairs = segments.join(signatures, on).withColumn("__ll", signature_score(F.col("avg_speed"), F.col("cadence"), F.col("hr_mean")))
    vetoed = hr_vetoed(F.col("hr_mean"), F.col("sig_hr_mean"), F.col("sig_hr_std")) | cadence_vetoed(F.col("cadence"), F.col("avg_speed"), F.col("sig_cadence_mean"), F.col("sig_cadence_std"))
    best = pairs.groupBy(*key).agg(
        F.max_by("sig_mode", F.when(~vetoed, F.struct("__ll", "sig_mode"))).alias("__best"), F.max(F.when(~vetoed, F.col("__ll"))).alias("__top"), F.max(F.when(F.col("sig_mode") == F.col("mode"), F.col("__ll"))).alias("__own")
    )
    out = segments.join(best, key, "left")
    move = F.coalesce((F.col("confidence_margin") < margin) & (F.col("__top") - F.col("__own") >= least), F.lit(False))
    return out.withColumn("mode", F.when(move, F.col("__best")).otherwise(F.col("mode"))).drop("__best", "__top", "__own")
