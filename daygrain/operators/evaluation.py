"""Decoded days against the truth: minutes, rides, floors and ceilings, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.operators.joins import in_interval, overlapping

#: Modes that count as one when days are scored.
CANONICAL = {"sleeping": "stationary", "bus": "driving", "vehicle": "driving", "unknown_rail": "train"}


def canonical(mode: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CANONICAL.items() for x in kv]), mode), mode)


def confusion(states: DataFrame, truth: DataFrame, on: list[str], grid: DataFrame) -> DataFrame:
    """Minutes by true and decoded mode (`none` where a side says nothing). grid: on, t."""
    a = in_interval(grid, truth.select(*on, "start_ts", "end_ts", canonical(F.col("mode")).alias("true_mode")), on, closed=False).select(*on, "t", "true_mode")
    b = in_interval(grid, states.select(*on, "start_ts", "end_ts", canonical(F.col("mode")).alias("mode")), on, closed=False).select(*on, "t", "mode")
    both = a.join(b, [*on, "t"], "full")
    return both.groupBy(F.coalesce("true_mode", F.lit("none")).alias("true_mode"), F.coalesce("mode", F.lit("none")).alias("mode")).agg(F.count("*").alias("minutes"))


def agreement(counts: DataFrame) -> DataFrame:
    """Per true mode: minutes, hit, recall."""
    hit = F.sum(F.when(F.col("true_mode") == F.col("mode"), F.col("minutes")).otherwise(0))
    return counts.groupBy("true_mode").agg(F.sum("minutes").alias("minutes"), hit.alias("hit"), (hit / F.sum("minutes")).alias("recall"))


def phantoms(rides: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Decoded rides of which no more than half overlaps a true one."""
    key = [*on, "start_ts", "end_ts"]
    seen = overlapping(rides.select(*key), truth.select(*on, "start_ts", "end_ts"), on).groupBy(*key).agg(F.sum("overlap_s").alias("__s"))
    out = rides.join(seen, key, "left")
    return out.where(F.coalesce("__s", F.lit(0)) * 2 <= F.col("end_ts") - F.col("start_ts")).drop("__s")


def journey_matches(found: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Each true ride with the decoded one that overlaps it most, and whether ends and line agree: board, alight, line."""
    pairs = overlapping(
        truth.select(*on, "start_ts", "end_ts", "board", "alight", "line"),
        found.select(*on, "start_ts", "end_ts", F.col("board").alias("f_board"), F.col("alight").alias("f_alight"), F.col("line").alias("f_line")), on,
    )
    key = [*on, "start_ts", "end_ts"]
    best = pairs.groupBy(*key).agg(F.max_by(F.struct("f_board", "f_alight", "f_line"), F.struct("overlap_s", F.negative("b_start_ts"))).alias("f"))
    out = truth.join(best, key, "left")
    eq = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return out.select(*key, F.col("f").isNotNull().alias("found"), eq("board", "f.f_board").alias("board_ok"), eq("alight", "f.f_alight").alias("alight_ok"), eq("line", "f.f_line").alias("line_ok"))


def floor_gate(known: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    """What once passed and no longer does; empty if the floor holds."""
    return known.join(now, key, "left_anti")


def floor_raised(known: DataFrame, now: DataFrame, key: list[str]) -> DataFrame:
    return known.select(*key).unionByName(now.select(*key)).distinct()


def ceiling_gate(known: DataFrame, now: DataFrame, key: list[str], count: str = "n") -> DataFrame:
    """Where there are more faults than the ceiling allows; a day without a ceiling allows none."""
    k = known.withColumnRenamed(count, "__most")
    return now.join(k, key, "left").withColumn("most", F.coalesce("__most", F.lit(0))).where(F.col(count) > F.col("most")).drop("__most")


def ceiling_lowered(known: DataFrame, now: DataFrame, key: list[str], count: str = "n") -> DataFrame:
    n = now.withColumnRenamed(count, "__now")
    return known.join(n, key, "left").withColumn(count, F.least(count, F.coalesce("__now", F.lit(0)))).drop("__now")


def state_diff(a: DataFrame, b: DataFrame, on: list[str], same: list[str]) -> DataFrame:
    """States of two runs by their place in the day: only_a, only_b or changed; equal ones are left out."""
    w = Window.partitionBy(*on).orderBy("start_ts", "end_ts")
    at = lambda d, n: d.select(*on, F.row_number().over(w).alias("ix"), F.struct("start_ts", "end_ts", *same).alias(n))
    both = at(a, "a").join(at(b, "b"), [*on, "ix"], "full")
    kind = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.withColumn("kind", kind).where("kind is not null")


def distance_stats(errors: DataFrame, keys: list[str], error: str = "error_m") -> DataFrame:
    """n, mean, median, p90 (nearest rank of the sorted errors) and largest."""
    p90 = F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY `{error}`)")
    return errors.groupBy(*keys).agg(
        F.count(error).alias("n"), F.avg(error).alias("mean_m"), F.median(error).alias("median_m"), p90.alias("p90_m"), F.max(error).alias("most_m")
    )


def truth_cell(text: Column) -> Column:
    """struct<mode, place, line, board, alight> of a note such as 'train Board → Alight · Line' or 'stay @ Place'; null for others."""
    from daygrain.functions.text import station_pair

    word = F.lower(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    rest = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]+\s*", ""))
    pair = station_pair(rest)
    mode = F.element_at(F.create_map(*[F.lit(x) for kv in {"stay": "stationary", "walk": "walking", "train": "train", "tube": "train", "drive": "driving", "car": "driving", "cycle": "cycling", "bus": "bus", "plane": "plane"}.items() for x in kv]), word)
    place = F.when(F.startswith(rest, F.lit("@")), F.trim(F.substring(rest, 2, 10_000)))
    return F.when(mode.isNotNull(), F.struct(mode.alias("mode"), place.alias("place"), pair["line"].alias("line"), pair["board"].alias("board"), pair["alight"].alias("alight")))


def score_stations(truth: DataFrame, decoded: DataFrame, on: list[str]) -> DataFrame:
    """One row: asserted, matching, missing. Each true leg (start_ts, end_ts, mode, board, alight) that names both its stations is held against the decoded
    leg of its mode that overlaps it most, by more than half of it; ties go to the earlier one. The rest of asserted is wrong."""
    legs = truth.where("board is not null and alight is not null").withColumn("__leg", F.monotonically_increasing_id())
    other = decoded.select(*on, "start_ts", "end_ts", F.col("mode").alias("d_mode"), F.col("board").alias("d_board"), F.col("alight").alias("d_alight"))
    key = [*on, "start_ts", "end_ts", "mode", "board", "alight"]
    met = overlapping(legs.select(*key), other, on).where((F.col("mode") == F.col("d_mode")) & (F.col("overlap_s") * 2 > F.col("end_ts") - F.col("start_ts")))
    best = met.groupBy(*key).agg(F.min_by(F.struct("d_board", "d_alight"), F.struct(-F.col("overlap_s"), F.col("b_start_ts"))).alias("b"))
    both = legs.join(best, key, "left")
    missing = F.col("b.d_board").isNull() | F.col("b.d_alight").isNull()
    hit = (F.lower("b.d_board") == F.lower("board")) & (F.lower("b.d_alight") == F.lower("alight"))
    return both.agg(F.count("*").alias("asserted"), F.count_if(hit).alias("matching"), F.count_if(missing).alias("missing"))


def verdict(status: Column, enforceable: Column, matches: Column) -> Column:
    """What a true row says of the run: unverified unless it is enforceable, then verified or regressed, of a known error cleared or known-error."""
    right = F.when(matches, "verified").otherwise("regressed")
    return F.when(~enforceable, "unverified").when(status == "correct", right).otherwise(F.when(matches, "cleared").otherwise("known-error"))
