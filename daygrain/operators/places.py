"""Places and venues: scores, ranks, priors. Scores are nats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.operators.aggregates import dwell_bucket
from daygrain.operators.joins import nearest_k, within_radius

PRESENCE_RADIUS_M = 150.0
STAY_FLOOR = -8.0
MAGNET_M = 110.0


def experience(days: Column) -> Column:
    """How settled a place is, 0 to 1."""
    return 1 - F.exp(-F.greatest(F.lit(0.0), days - 1) / 10)


def place_sigma(radius_m: Column, days: Column) -> Column:
    return F.greatest(radius_m, 40 + 60 * experience(days))


def hour_match(profile: Column, weights: Column) -> Column:
    """How well a stay's hours (an array of 24 weights) fit a place's profile, against an even one; 0 without a profile."""
    each = F.zip_with(profile, weights, lambda p, w: w * F.log(p + 0.02))
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.when(profile.isNull(), 0.0).otherwise(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) - total * F.log(F.lit(1 / 24 + 0.02)))


def magnet(distance_m: Column, days: Column, coherence: Column) -> Column:
    """How far a well-known place reaches, 1 to 2, near it."""
    return F.when(distance_m <= MAGNET_M, F.least(F.lit(2.0), 1 + F.log(1 + days) * coherence / 10)).otherwise(1.0)


def place_scores(pairs: DataFrame) -> DataFrame:
    """score and reachable for pairs of a stay and a place: distance_m, radius_m, days, profile, weights, coherence."""
    d, days = F.col("distance_m"), F.col("days").cast("double")
    sigma, m = place_sigma(F.col("radius_m"), days), magnet(d, days, F.col("coherence"))
    bonus = F.when(d <= MAGNET_M, F.log(1 + days) * F.col("coherence")).otherwise(0.0)
    score = -(d * d) / (2 * sigma * sigma) + F.log(days + 1) + hour_match(F.col("profile"), F.col("weights")) + bonus
    reach = F.least(3 * sigma * m, 90 + 910 * experience(days))
    return pairs.withColumn("score", score).withColumn("reachable", d <= reach)


def best_place(pairs: DataFrame, key: list[str], place_id: str = "place_id") -> DataFrame:
    """Of each stay the reachable place with the best score, if that is not below the floor; ties go to the nearer, then the smaller id."""
    ok = place_scores(pairs).where(F.col("reachable") & (F.col("score") >= STAY_FLOOR))
    w = Window.partitionBy(*key).orderBy(F.col("score").desc(), "distance_m", place_id)
    return ok.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def current_place(fixes: DataFrame, places: DataFrame, key: list[str], place_id: str = "place_id", radius_m: float = PRESENCE_RADIUS_M) -> DataFrame:
    """The nearest place within the radius of each fix."""
    return nearest_k(within_radius(fixes, places, radius_m), key, 1, place_id).drop("rank")


def reachable(places: DataFrame, fixes: DataFrame, on: list[str], far_m: float = 2000.0, pinned: str = "pinned") -> DataFrame:
    """Places of one's own within `far_m` of a fix of the day, and pinned ones."""
    f = fixes.select(*[F.col(k).alias(f"f_{k}") for k in on], F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
    p = places.withColumnsRenamed({"p_lat": "lat", "p_lon": "lon"})
    near = within_radius(p, f, far_m)
    for k in on:
        near = near.where(F.col(k) == F.col(f"f_{k}"))
    near = near.select(*on, "place_id").distinct()
    return places.join(near.withColumn("__near", F.lit(True)), [*on, "place_id"], "left").where(F.coalesce("__near", F.lit(False)) | F.coalesce(pinned, F.lit(False))).drop("__near")


def venue_priors(visits: DataFrame) -> DataFrame:
    """Per kind of venue (subtype, category) and dwell bucket and hour the mass of visits: subtype, category, dwell, hour, mass. visits: subtype, category,
    minutes, hour, weight (1 for a certain visit)."""
    v = visits.withColumn("dwell", dwell_bucket(F.col("minutes")))
    return v.groupBy("subtype", "category", "dwell", "hour").agg(F.sum("weight").alias("mass"))


def effective_sample(weights: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Kish's effective number of weighted samples."""
    w = F.col(weight)
    return weights.groupBy(*keys).agg((F.pow(F.sum(w), 2) / F.sum(w * w)).alias("effective_n"))


def bin_probability(subtype_mass: Column, subtype_n: Column, category_mass: Column, category_n: Column, dims: int, pseudo: float, most: float = 12.0) -> Column:
    """A bin's probability from a subtype's mass and that of its category, which counts `most` visits at most."""
    scale = F.when(category_n > most, most / category_n).otherwise(1.0)
    return (subtype_mass + category_mass * scale + pseudo / dims) / (subtype_n + category_n * scale + pseudo)


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def venue_shape(base: Column, kinds: Column, dwell_p: Column, hour_p: Column) -> Column:
    """Nats of a kind of venue by how often, how long and when it is visited."""
    return _clamp(F.log(base * F.greatest(kinds, F.lit(8))), -2.0, 1.5) + _clamp(F.log(dwell_p * 4), -2.0, 1.2) + _clamp(F.log(hour_p * 24), -1.5, 1.2)


def venue_score(distance_m: Column, is_venue: Column, shape: Column, open_share: Column) -> Column:
    """Distance, being a venue rather than an area, its kind, and its opening hours (null: unknown)."""
    hours = F.when(open_share.isNull(), 0.0).otherwise(-2.5 + open_share * 3.2)
    return -0.5 * F.pow(distance_m / 40, 2) + F.when(is_venue, 1.5).otherwise(0.0) + shape + hours


def rank_venues(candidates: DataFrame, key: list[str], floor: float = -1.5, near_m: float = 12.0) -> DataFrame:
    """Candidates (name, distance_m, is_venue, encloses, shape, open_share) with total and rank: what encloses the stay first, then open ones within
    `near_m` by distance, then by score; others below the floor go."""
    c = candidates.withColumn("total", venue_score(F.col("distance_m"), F.col("is_venue"), F.col("shape"), F.col("open_share")))
    near = (F.col("distance_m") <= near_m) & (F.col("open_share").isNull() | (F.col("open_share") > 0))
    tier = F.when(F.col("encloses"), 0).when(near, 1).otherwise(2)
    c = c.withColumn("tier", tier).where((F.col("tier") < 2) | (F.col("total") >= floor))
    w = Window.partitionBy(*key).orderBy("tier", F.when(F.col("tier") < 2, F.col("distance_m")).otherwise(0.0), F.col("total").desc(), "distance_m", "name")
    return c.withColumn("rank", F.row_number().over(w))


def responsibilities(candidates: DataFrame, key: list[str], other: float = -1.5) -> DataFrame:
    """Softmax of the totals of a stay's candidates and of 'none of them'."""
    w = Window.partitionBy(*key)
    top = F.greatest(F.max("total").over(w), F.lit(other))
    mass = F.exp(F.col("total") - top)
    return candidates.withColumn("responsibility", mass / (F.sum(mass).over(w) + F.exp(other - top)))


def attributed(pairs: DataFrame, key: list[str], near_m: float = 30.0, apart_m: float = 20.0) -> DataFrame:
    """The nearest venue of a stay, within `near_m`, if the next with another name is `apart_m` farther or more."""
    w = Window.partitionBy(*key).orderBy("distance_m", "name")
    ranked = pairs.withColumn("__n", F.row_number().over(w)).withColumn("__first", F.first("name").over(w))
    other = F.min(F.when(F.col("name") != F.col("__first"), F.col("distance_m")))
    out = ranked.groupBy(*key).agg(F.first("__first").alias("name"), F.min("distance_m").alias("distance_m"), other.alias("other_m"))
    return out.where((F.col("distance_m") <= near_m) & (F.col("other_m").isNull() | (F.col("other_m") - F.col("distance_m") >= apart_m)))


def long_stay(distance_m: Column, sleep_hours: Column, dwell_s: Column, visits: Column) -> Column:
    """Within 100 m of a place with four sleep hours or a mean dwell of two hours."""
    return (distance_m <= 100) & ((F.coalesce(sleep_hours, F.lit(0)) >= 4) | (F.coalesce(dwell_s / visits, F.lit(0.0)) >= 7200))


def entry_prior(visits: DataFrame, key: list[str], hour: Column) -> DataFrame:
    """ln(24 max(p_h, .001)) + ln(n w) of entering each place: place_id, profile (array of 24), weight (null: a tenth of an even share)."""
    n = F.count("*").over(Window.partitionBy(*key))
    p = F.coalesce(F.element_at("profile", hour + 1), F.lit(1 / 24))
    w = F.coalesce("weight", 1 / (10 * n))
    return visits.withColumn("entry", F.log(24 * F.greatest(p, F.lit(0.001))) + F.log(n * w))


def continuity(hours: Column, posterior: Column, has_fix: Column, last_fix_m: Column) -> Column:
    """Nats for still being at the place of the evening before, in minutes without a fix."""
    return F.when(has_fix | (F.coalesce(last_fix_m, F.lit(0.0)) > 1500), 0.0).otherwise(F.log(1 + 0.1 * F.exp(-hours / 24) * posterior))


def snapshot_scores(candidates: DataFrame, factors: dict[str, Column], key: list[str], tie: Column) -> DataFrame:
    """Candidates with each factor (null: it says nothing), their total, rank, margin over the runner-up and a confidence word.

    Ties go by `tie`, ascending. A group without candidates has no row."""
    out = candidates.withColumns(factors)
    total = F.lit(0.0)
    for name in factors:
        total = total + F.coalesce(name, F.lit(0.0))
    w = Window.partitionBy(*key).orderBy(F.col("total").desc(), tie)
    out = out.withColumn("total", total).withColumn("rank", F.row_number().over(w))
    out = out.withColumn("margin", F.coalesce(F.col("total") - F.lead("total").over(w), F.lit(float("inf"))))
    return out.withColumn("confidence", F.when(F.col("margin") > 2, "high").when(F.col("margin") > 0.5, "medium").otherwise("low"))


#: Nats of a mode by speed alone, as (above km/h, nats) from the fastest, and what holds below.
SPEED_STEPS = {
    "driving": ((25, 1.0), (15, 0.3), (8, -0.5), (None, -7.0)),
    "train": ((40, 1.0), (15, 0.0), (None, -7.0)),
}


def speed_factor(mode: Column, speed: Column) -> Column:
    out = F.when(mode == "walking", F.when(speed > 15, -3.0).when((speed >= 2) & (speed <= 8), 0.5).otherwise(0.0))
    for name, steps in SPEED_STEPS.items():
        inner = None
        for above, nats in steps:
            if above is None:
                inner = inner.otherwise(nats)
            else:
                inner = F.when(speed > above, nats) if inner is None else inner.when(speed > above, nats)
        out = out.when(mode == name, inner)
    return out


def way_factor(distance_m: Column) -> Column:
    return -F.log(F.greatest(distance_m, F.lit(1.0)) / 25)


def rail_factor(mode: Column, road_m: Column, rail_m: Column) -> Column:
    r = F.log((road_m + 25) / (rail_m + 25))
    return F.when(mode == "train", r).when(mode == "driving", -r)


def prior_factor(mode: Column) -> Column:
    return F.when(mode == "cycling", -4.0).otherwise(0.0)


def classifier_factor(mode: Column, original: Column, margin: Column) -> Column:
    return F.when((mode == original) & (margin > 2), F.least(F.lit(4.0), 1.5 * F.log(margin / 2))).otherwise(0.0)


def station_tier(name: Column, subtype: Column, prefer: str | None = None) -> Column:
    """0 for a station (of the subtype that is looked for, if any), 1 for another kind of station, 2 for a platform's position, 3 for an entrance: a
    subway entrance or a name such as A or B2."""
    gate = (subtype == "subway_entrance") | name.rlike(r"^[A-Z]\d?$")
    return F.when(F.coalesce(gate, F.lit(False)), 3).when(subtype == "stop_position", 2).otherwise(F.lit(0) if prefer is None else F.when(subtype.eqNullSafe(F.lit(prefer)), 0).otherwise(1))


def rank_stations(near: DataFrame, key: list[str], prefer: str | None = None) -> DataFrame:
    """Stations near something (name, subtype, distance_m) with tier and rank, the best first: by tier, then by distance; ties by name."""
    w = Window.partitionBy(*key).orderBy("tier", "distance_m", "name")
    return near.withColumn("tier", station_tier(F.col("name"), F.col("subtype"), prefer)).withColumn("rank", F.row_number().over(w))


def station_key(name: Column) -> Column:
    """A station's name as names are compared: ASCII letters and digits, lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def served(stops: DataFrame, asked: DataFrame, least_stops: int = 5, least_chars: int = 10) -> DataFrame:
    """Pairs asked for (line, name) with `served`: whether the line stops there, null where fewer than `least_stops` of its stops (line, name) are known.

    Names agree if their keys do, or if one key holds the other and both have `least_chars` or more."""
    s = stops.where("name is not null").select("line", station_key(F.col("name")).alias("__stop")).distinct()
    known = s.groupBy("line").agg(F.count("*").alias("__n")).where(F.col("__n") >= least_stops)
    a = asked.withColumn("__key", station_key(F.col("name")))
    inside = (F.least(F.length("__key"), F.length("__stop")) >= least_chars) & (F.contains("__key", "__stop") | F.contains("__stop", "__key"))
    hit = a.join(s, "line").where((F.col("__key") == F.col("__stop")) | inside).select("line", "name").distinct().withColumn("__hit", F.lit(True))
    out = a.join(known, "line", "left").join(hit, ["line", "name"], "left")
    return out.withColumn("served", F.when(F.col("__n").isNotNull(), F.coalesce("__hit", F.lit(False)))).drop("__key", "__n", "__hit")
