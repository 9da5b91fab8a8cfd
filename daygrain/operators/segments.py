"""From windows of a track to segments: features, mode scores, runs of one mode, gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import geo
from daygrain.functions.chance import closeness as near
from daygrain.operators.joins import as_of, in_interval
from daygrain.operators.series import hops, islands

MODES = ("stationary", "walking", "cycling", "driving", "train", "plane")


def window_features(track: DataFrame, keys: list[str], tie: str, win: str = "win") -> DataFrame:
    """Per window of two fixes or more: start_ts, end_ts, lat, lon (means), med, most, var (sample) of speed_kmh, hcr (degrees of turning a second), lin
    (straight by path, at most 1), burst (share of accelerations above 5 km/h a second... counted), stop (share below 1 km/h), net, rad, n."""
    w = Window.partitionBy(*keys, win).orderBy("t", tie)
    dt = F.col("t") - F.lag("t").over(w)
    head = geo.bearing(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    p = track.withColumns(
        {
            "__dt": dt, "__hop": geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), "__head": head,
            "__dv": F.col("speed_kmh") - F.lag("speed_kmh").over(w), "__clat": F.avg("lat").over(Window.partitionBy(*keys, win)), "__clon": F.avg("lon").over(Window.partitionBy(*keys, win)),
        }
    )
    p = p.withColumn("__turn", geo.turn(F.col("__head"), F.lag("__head").over(w)))
    burst = F.count_if((F.col("__dt") > 0) & (F.col("__dv") / F.col("__dt") > 5 / 3.6))
    net = geo.haversine(F.min_by("lat", F.struct("t", tie)), F.min_by("lon", F.struct("t", tie)), F.max_by("lat", F.struct("t", tie)), F.max_by("lon", F.struct("t", tie)))
    path = F.sum("__hop")
    out = p.groupBy(*keys, win).agg(
        F.min("t").alias("start_ts"), F.max("t").alias("end_ts"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.median("speed_kmh").alias("med"), F.max("speed_kmh").alias("most"),
        F.coalesce(F.var_samp("speed_kmh"), F.lit(0.0)).alias("var"), F.coalesce(F.sum("__turn") / F.nullif(F.sum("__dt"), F.lit(0)), F.lit(0.0)).alias("hcr"),
        F.coalesce(F.least(F.lit(1.0), net / F.nullif(path, F.lit(0.0))), F.lit(0.0)).alias("lin"), burst.alias("burst"), F.avg((F.col("speed_kmh") < 1).cast("double")).alias("stop"), net.alias("net"),
        F.max(geo.haversine(F.col("__clat"), F.col("__clon"), F.col("lat"), F.col("lon"))).alias("rad"), F.count("*").alias("n"),
    )
    return out.where("n >= 2")


def mode_scores() -> dict[str, Column]:
    """The six modes' scores over a window's features, by their formulas."""
    med, most, var, lin, hcr, burst, stop, net, rad = (F.col(c) for c in ("med", "most", "var", "lin", "hcr", "burst", "stop", "net", "rad"))
    times = lambda on, k: F.when(on, k).otherwise(1.0)
    return {
        "stationary": near(med, 0, 1.5) * (1 + stop) * times(rad < 30, 3.0) * times(rad < 15, 3.0) * times(net < 20, 2.0) * times((most > 20) & (net > 200), 0.1),
        "walking": near(med, 4, 3) * near(lin, 0.5, 0.4) * (1 + 0.5 * hcr) * times(most > 15, 0.1) * times(rad < 30, 0.1) * times(net < 30, 0.2),
        "cycling": near(med, 18, 8) * near(lin, 0.7, 0.3) * near(var, 15, 20) * times(most > 50, 0.1),
        "driving": near(med, 60, 35) * (1 + 0.3 * burst) * near(lin, 0.7, 0.3) * times(med < 10, 0.1),
        "train": near(med, 120, 60) * near(lin, 0.95, 0.1) * near(var, 5, 15) * near(hcr, 0.5, 2) * times(med < 30, 0.1),
        "plane": near(med, 500, 300) * near(lin, 0.99, 0.05) * near(var, 2, 10) * times(med < 150, 0.01),
    }


def score_windows(features: DataFrame) -> DataFrame:
    """Windows with mode, confidence (its share of all scores) and margin (over the runner-up, at most 1000). Equal scores go by the modes' order."""
    scored = features.withColumns({f"__{m}": s for m, s in mode_scores().items()})
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"__{m}")).alias("s"), F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(MODES)]))
    scored = scored.withColumn("__r", ranked)
    total = sum((F.col(f"__{m}") for m in MODES[1:]), F.col(f"__{MODES[0]}"))
    top, second = -F.col("__r")[0]["s"], -F.col("__r")[1]["s"]
    scored = scored.withColumn("mode", F.col("__r")[0]["m"]).withColumn("confidence", F.when(total > 0, top / total).otherwise(0.0))
    scored = scored.withColumn("margin", F.when(second > 0, F.least(F.lit(1000.0), top / second)).otherwise(1000.0))
    return scored.drop("__r", *[f"__{m}" for m in MODES])


def merge_windows(windows: DataFrame, keys: list[str], apart_m: float = 100.0) -> DataFrame:
    """Runs of windows of one mode as segments; stays are cut where a window's centre lies `apart_m` from the one before.

    confidence and margin are means (two decimals), avg_speed the median of medians (one), max_speed the largest, linearity the mean (two)."""
    w = Window.partitionBy(*keys).orderBy("start_ts", "win")
    moved = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) > apart_m
    marked = islands(windows, keys, ["start_ts", "win"], ["mode"], (F.col("mode") == "stationary") & moved)
    return marked.groupBy(*keys, "island").agg(
        F.first("mode").alias("mode"), F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.round(F.avg("confidence"), 2).alias("confidence"), F.round(F.avg("margin"), 2).alias("confidence_margin"),
        F.round(F.median("med"), 1).alias("avg_speed"), F.max("most").alias("max_speed"), F.round(F.avg("lin"), 2).alias("linearity"), F.sum("n").alias("points"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
    ).drop("island")


def transit_gaps(segments: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """Segments for the gaps of 180 s or more between neighbours over which the track moved 200 m or more: mode by implied speed, confidence 0.3 (0.1 if
    unknown). fixes: t, lat, lon."""
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts")
    g = segments.select(*keys, F.col("end_ts").alias("start_ts"), F.lead("start_ts").over(w).alias("end_ts"), F.col("mode").alias("__m1"), F.lead("mode").over(w).alias("__m2"))
    g = g.where(F.col("end_ts") - F.col("start_ts") >= 180)
    f = fixes.select(*keys, "t", "lat", "lon")
    g = as_of(g.withColumn("t", F.col("start_ts")), f, keys, "t", ["lat", "lon"], prefix="a_")
    g = as_of(g.withColumn("t", F.col("end_ts")), f, keys, "t", ["lat", "lon"], ahead=True, prefix="b_")
    d = geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    g = g.withColumn("displacement_m", d).where("displacement_m >= 200")
    length = F.col("end_ts") - F.col("start_ts")
    g = g.withColumn("avg_speed", F.col("displacement_m") / length * 3.6)
    rail = F.col("__m1").isin("train") | F.col("__m2").isin("train")
    mode = (
        F.when((F.col("avg_speed") < 1.5) & (length >= 1800), "unknown").when(F.col("avg_speed") < 7, "walking").when(F.col("avg_speed") >= 120, "train").when(rail, "train").otherwise("driving")
    )
    g = g.withColumn("mode", mode).withColumn("confidence", F.when(F.col("mode") == "unknown", 0.1).otherwise(0.3))
    return g.select(*keys, "start_ts", "end_ts", "mode", "confidence", F.round("avg_speed", 1).alias("avg_speed"), F.round("displacement_m", 1).alias("displacement_m"))


def road_confidence(mode: Column, confidence: Column, road_share: Column) -> Column:
    return F.when(mode == "driving", F.round(confidence * (0.5 + F.greatest(F.lit(0.0), F.least(F.lit(0.5), road_share))), 2)).otherwise(confidence)


def refined_mode(original: Column, speed: Column, kind: Column, subtype: Column, rail_m: Column, road_m: Column) -> Column:
    """What the way under a segment makes of its mode; the first rule that holds wins."""
    big = subtype.isin("motorway", "trunk", "primary")
    return (
        F.when(kind == "aeroway", F.when(subtype.isin("runway", "taxiway"), "plane").otherwise("stationary"))
        .when((kind == "railway") & (speed > 30) & F.coalesce(rail_m <= road_m, F.lit(True)), "train")
        .when((original == "train") & (kind != "railway"), "driving")
        .when((kind == "highway") & subtype.isin("footway", "path", "pedestrian") & (speed < 10), "walking")
        .when((kind == "highway") & (subtype == "cycleway"), "cycling").when((kind == "highway") & big & (speed > 30), "driving").when(kind == "highway", original)
        .when((kind == "waterway") & subtype.isin("river", "canal", "fairway") & speed.between(3, 50), "boat").otherwise(original)
    )


def implausible_driving(mode: Column, most: Column, has_motorway: Column, subway_m: Column) -> Column:
    on = (mode == "driving") & (most > 80) & ~has_motorway & (subway_m < 100)
    return F.when(F.coalesce(on, F.lit(False)), "train").otherwise(mode)


def effective_mode(mode: Column, refined: Column) -> Column:
    """A segment's mode as it is shown: the refined one where there is one."""
    return F.coalesce(refined, mode)


def smooth_short(segments: DataFrame, keys: list[str], least_s: int = 120) -> DataFrame:
    """Segments shorter than `least_s` go into the one before, one after another; a key's first stays whatever its length.

    Of a run the end is the last one's, points are summed, max_speed is the largest, other columns are the first one's."""
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts")
    keeps = (F.row_number().over(w) == 1) | (F.col("end_ts") - F.col("start_ts") >= least_s)
    marked = segments.withColumn("__run", F.sum(keeps.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in segments.columns if c not in (*keys, "start_ts", "end_ts", "points", "max_speed")]
    at = F.struct("start_ts", "end_ts")
    told = {"points": F.sum("points"), "max_speed": F.max("max_speed")}
    out = marked.groupBy(*keys, "__run").agg(
        F.min("start_ts").alias("start_ts"), F.max_by("end_ts", at).alias("end_ts"), *[told[c].alias(c) for c in told if c in segments.columns], *[F.min_by(c, at).alias(c) for c in rest]
    )
    return out.select(*segments.columns)


def window_stats(parts: DataFrame, fixes: DataFrame, keys: list[str], tie: str = "event_id", exclude_start: bool = False) -> DataFrame:
    """Parts of segments (keys, start_ts, end_ts) with what their own fixes tell: points, avg_speed (the median), max_speed, linearity; zeros without any.

    exclude_start: the fix on start_ts, on which a vehicle arrived, doesn't count. Both ends count else. A null speed is 0."""
    key = [*keys, "start_ts", "end_ts"]
    f = in_interval(fixes.select(*keys, "t", tie, "lat", "lon", F.coalesce("speed_kmh", F.lit(0.0)).alias("speed_kmh")), parts.select(*key), keys)
    if exclude_start:
        f = f.where("t > start_ts")
    f = hops(f, key, ["t", tie])
    first, last = F.min_by(F.struct("lat", "lon"), F.struct("t", tie)), F.max_by(F.struct("lat", "lon"), F.struct("t", tie))
    a = f.groupBy(*key).agg(F.count("*").alias("points"), F.median("speed_kmh").alias("__med"), F.max("speed_kmh").alias("__most"), F.sum("hop_m").alias("__path"), first.alias("__a"), last.alias("__b"))
    net = geo.haversine(F.col("__a.lat"), F.col("__a.lon"), F.col("__b.lat"), F.col("__b.lon"))
    a = a.withColumn("linearity", F.when(F.col("__path") > 0, F.round(F.least(net / F.col("__path"), F.lit(1.0)), 2)))
    out = parts.join(a.select(*key, "points", F.round("__med", 1).alias("avg_speed"), F.round("__most", 1).alias("max_speed"), "linearity"), key, "left")
    return out.fillna({"points": 0, "avg_speed": 0.0, "max_speed": 0.0, "linearity": 0.0})
