"""The day's timeline: non-overlapping states from segments and sleep, and what is inferred around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import geo
from daygrain.operators.joins import overlapping
from daygrain.operators.series import islands


def day_states(segments: DataFrame, sleeps: DataFrame, on: list[str]) -> DataFrame:
    """Cuts a day at every boundary of segments and sleeps, and tells each piece by its middle: start_ts, end_ts, mode, place, asleep.

    A stay at the sleep's place is `sleeping`; moving while asleep keeps its mode and is marked; sleep without a segment makes a state only if the
    sleep has a place. segments: mode, place; sleeps: place. Of overlapping segments the one that starts last tells."""
    edge = lambda d: d.select(*on, F.explode(F.array("start_ts", "end_ts")).alias("at"))
    cuts = edge(segments).unionByName(edge(sleeps)).distinct()
    w = Window.partitionBy(*on).orderBy("at")
    pieces = cuts.select(*on, F.col("at").alias("start_ts"), F.lead("at").over(w).alias("end_ts")).where("end_ts > start_ts")
    pieces = pieces.withColumn("piece", F.col("start_ts"))
    key = [*on, "start_ts", "end_ts"]
    covers = lambda p: (F.col("b_start_ts") <= (F.col("start_ts") + F.col("end_ts")) / 2) & ((F.col("start_ts") + F.col("end_ts")) / 2 < F.col("b_end_ts"))
    seg = overlapping(pieces, segments.select(*on, "start_ts", "end_ts", F.col("mode").alias("s_mode"), F.col("place").alias("s_place")), on).where(covers(None))
    seg = seg.groupBy(*key).agg(F.max_by(F.struct("s_mode", "s_place"), F.struct("b_start_ts", "b_end_ts", "s_mode")).alias("s"))
    slp = overlapping(pieces, sleeps.select(*on, "start_ts", "end_ts", F.col("place").alias("z_place")), on).where(covers(None))
    slp = slp.groupBy(*key).agg(F.max_by(F.struct("z_place"), F.struct("b_start_ts", "b_end_ts")).alias("z"))
    both = pieces.drop("piece").join(seg, key, "left").join(slp, key, "left")
    mode, place, z = F.col("s.s_mode"), F.col("s.s_place"), F.col("z")
    asleep = z.isNotNull()
    same = place.eqNullSafe(F.col("z.z_place")) | F.col("z.z_place").isNull()
    state = F.when(mode.isNull(), F.when(asleep & F.col("z.z_place").isNotNull(), "sleeping")).when(asleep & (mode == "stationary") & same, "sleeping").otherwise(mode)
    out = both.select(*key, state.alias("mode"), F.coalesce(place, F.when(mode.isNull(), F.col("z.z_place"))).alias("place"), F.when(state != "sleeping", asleep).otherwise(True).alias("asleep"))
    return merge_touching(out.where("mode is not null"), on, ["mode", "place", "asleep"])


def merge_touching(states: DataFrame, on: list[str], same: list[str]) -> DataFrame:
    """Neighbours that touch and agree in `same` become one."""
    w = Window.partitionBy(*on).orderBy("start_ts", "end_ts")
    marked = islands(states, on, ["start_ts", "end_ts"], same, F.col("start_ts") > F.lag("end_ts").over(w))
    rest = [c for c in states.columns if c not in (*on, *same, "start_ts", "end_ts")]
    out = marked.groupBy(*on, "island").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), *[F.first(c).alias(c) for c in [*same, *rest]])
    return out.select(*on, "start_ts", "end_ts", *same, *rest)


def clip_future(states: DataFrame, now: Column) -> DataFrame:
    """Inferred states end now; those that are wholly ahead go."""
    kept = states.where(~(F.col("inferred") & (F.col("start_ts") >= now)))
    return kept.withColumn("end_ts", F.when(F.col("inferred"), F.least(F.col("end_ts"), now)).otherwise(F.col("end_ts")))


def sleep_places(sleeps: DataFrame, segments: DataFrame, on: list[str], most_gap_s: int = 21_600) -> DataFrame:
    """Sleeps with the place of the stay that overlaps them, else of the one before bedtime, else of the one after waking, at most six hours apart;
    the smallest gap first."""
    s = segments.where((F.col("mode") == "stationary") & F.col("place").isNotNull())
    wide = sleeps.select(*on, (F.col("start_ts") - most_gap_s).alias("start_ts"), (F.col("end_ts") + most_gap_s).alias("end_ts"), F.col("start_ts").alias("z_start"), F.col("end_ts").alias("z_end"))
    pairs = overlapping(wide, s.select(*on, "start_ts", "end_ts", F.col("place").alias("s_place")), on)
    rank = F.when((F.col("b_start_ts") < F.col("z_end")) & (F.col("z_start") < F.col("b_end_ts")), 0).when(F.col("b_end_ts") <= F.col("z_start"), 1).otherwise(2)
    gap = F.when(rank == 0, 0).when(rank == 1, F.col("z_start") - F.col("b_end_ts")).otherwise(F.col("b_start_ts") - F.col("z_end"))
    best = pairs.groupBy(*on, "z_start", "z_end").agg(F.min_by("s_place", F.struct(rank.alias("r"), gap.alias("g"), F.col("b_start_ts"), F.col("s_place"))).alias("place"))
    return sleeps.drop("place").join(best.withColumnsRenamed({"z_start": "start_ts", "z_end": "end_ts"}), [*on, "start_ts", "end_ts"], "left")


def inferred_days(days: DataFrame, last_places: DataFrame, on: list[str]) -> DataFrame:
    """Days without a fix that the same place brackets: a stay there, inferred. days: start_ts, end_ts, n_fixes; last_places: t, place."""
    from daygrain.operators.joins import as_of

    empty = days.where("n_fixes = 0").withColumn("t", F.col("start_ts"))
    a = as_of(empty, last_places, on, "t", ["place"], prefix="a_").withColumn("t", F.col("end_ts"))
    b = as_of(a, last_places, on, "t", ["place"], ahead=True, prefix="b_")
    return b.where(F.col("a_place") == F.col("b_place")).select(*on, "start_ts", "end_ts", F.lit("stationary").alias("mode"), F.col("a_place").alias("place"), F.lit(True).alias("inferred"))


def dwell_continuation(last: DataFrame, places: DataFrame, on: list[str], least_days: int = 5, near_m: float = 120.0) -> DataFrame:
    """How long the day's last stay may be taken to go on: until_ts = end + tau ln 2, tau being the place's mean dwell. last: lat, lon, end_ts;
    places: place_id, p_lat, p_lon, days, dwell_s, visits."""
    p = places.where((F.col("days") >= least_days) & (F.col("visits") > 0))
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    pairs = last.join(p, on).withColumn("__d", d).where(F.col("__d") <= near_m)
    w = Window.partitionBy(*on).orderBy("__d", "place_id")
    best = pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    tau = F.col("dwell_s") / F.col("visits")
    return best.select(*on, "place_id", "end_ts", F.round(F.col("end_ts") + tau * F.log(F.lit(2.0))).cast("long").alias("until_ts"))


def grammar_faults(states: DataFrame, on: list[str]) -> DataFrame:
    """Where a day can't be: fault, start_ts. Two vehicles that touch and differ; two places of rest that touch; a ride that ends where it began."""
    w = Window.partitionBy(*on).orderBy("start_ts", "end_ts")
    vehicle, rest = F.col("mode").isin("driving", "train", "bus", "plane", "vehicle", "boat"), F.col("mode").isin("stationary", "sleeping")
    touch = F.lead("start_ts").over(w) == F.col("end_ts")
    next_mode, next_place = F.lead("mode").over(w), F.lead("place").over(w)
    next_vehicle = next_mode.isin("driving", "train", "bus", "plane", "vehicle", "boat")
    faults = F.array_compact(
        F.array(
            F.when(touch & vehicle & next_vehicle & (next_mode != F.col("mode")), "vehicles_touch"),
            F.when(touch & rest & next_mode.isin("stationary", "sleeping") & (next_place != F.col("place")), "places_touch"),
            F.when(vehicle & (F.col("board") == F.col("alight")), "round_ride"),
        )
    )
    return states.withColumn("__faults", faults).select(*on, "start_ts", F.explode("__faults").alias("fault"))


def infeasible(states: DataFrame, on: list[str], most_kmh: dict[str, float]) -> DataFrame:
    """States whose speed is above what their mode allows, and moves between stays that touch though far apart: start_ts, fault."""
    limit = F.element_at(F.create_map(*[x for m, v in most_kmh.items() for x in (F.lit(m), F.lit(v))]), F.col("mode"))
    w = Window.partitionBy(*on).orderBy("start_ts", "end_ts")
    gap = F.lead("start_ts").over(w) - F.col("end_ts")
    jump = geo.haversine(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    rest = F.col("mode") == "stationary"
    faults = F.array_compact(F.array(F.when(F.col("avg_speed") > limit, "too_fast"), F.when(rest & (F.lead("mode").over(w) == "stationary") & (gap <= 60) & (jump > 500), "teleport")))
    return states.withColumn("__faults", faults).select(*on, "start_ts", F.explode("__faults").alias("fault"))
