"""Joins by time and place that a plain equality can't state: in an interval, overlapping, as of, nearest, within a radius.

Ranges are cut into cells of a fixed size, so that each becomes an equality that Spark shuffles or broadcasts as it sees fit,
and the exact condition is checked after it. No join here is a cross product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import geo


def _cells(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(end / size)))


def in_interval(points: DataFrame, spans: DataFrame, on: list[str], t: str = "t", start: str = "start_ts", end: str = "end_ts", closed: bool = True, size: int = 3600, how: str = "inner") -> DataFrame:
    """Each point with each span of its key that holds it; both ends included if `closed`, else the end isn't. how: inner or left (keeps spans without points)."""
    p = points.withColumn("__cell", F.floor(F.col(t) / size)).alias("p")
    s = spans.where(F.col(start) <= F.col(end)).withColumn("__cell", _cells(F.col(start), F.col(end), size)).alias("s")
    at, begin, stop = F.col(f"p.{t}"), F.col(f"s.{start}"), F.col(f"s.{end}")
    match = (at >= begin) & ((at <= stop) if closed else (at < stop))
    for k in [*on, "__cell"]:
        match = match & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    found = p.join(s, match).select(*[F.col(f"s.{c}").alias(c) for c in spans.columns], *[F.col(f"p.{c}").alias(c) for c in points.columns if c not in on])
    if how == "inner":
        return found
    none = spans.join(found.select(*on, start, end).distinct(), [*on, start, end], "left_anti")
    return found.unionByName(none, allowMissingColumns=True)


def overlapping(a: DataFrame, b: DataFrame, on: list[str], size: int = 21_600) -> DataFrame:
    """Pairs of spans of one key that share time, with overlap_s. Both sides have start_ts and end_ts; those of `b` come out as b_start_ts, b_end_ts."""
    other = b.withColumnsRenamed({"start_ts": "b_start_ts", "end_ts": "b_end_ts"})
    x = a.where("start_ts < end_ts").withColumn("__cell", _cells(F.col("start_ts"), F.col("end_ts"), size))
    y = other.where("b_start_ts < b_end_ts").withColumn("__cell", _cells(F.col("b_start_ts"), F.col("b_end_ts"), size))
    both = x.join(y, [*on, "__cell"]).where((F.col("start_ts") < F.col("b_end_ts")) & (F.col("b_start_ts") < F.col("end_ts")))
    # A pair meets in each cell that both reach into; the cell where the later one starts counts.
    both = both.where(F.col("__cell") == F.floor(F.greatest("start_ts", "b_start_ts") / size)).drop("__cell")
    return both.withColumn("overlap_s", F.least("end_ts", "b_end_ts") - F.greatest("start_ts", "b_start_ts"))


def as_of(left: DataFrame, right: DataFrame, on: list[str], t: str, values: list[str], tie: str | None = None, ahead: bool = False, within_s: int | None = None, prefix: str = "asof_") -> DataFrame:
    """`left` with the last row of `right` at or before its time (the first at or after, if `ahead`), as <prefix><value> and <prefix>t.

    One sort of both sides together; ties of `right` go by `tie`, in its own type's order. Beyond `within_s` the values are null."""
    pick = F.struct(F.col(t).alias("t"), *[F.col(v) for v in values])
    tie_col = F.col(tie) if tie else F.lit("")
    r = right.select(*on, F.col(t).alias("__t"), F.lit(-1 if not ahead else 1).alias("__side"), tie_col.alias("__tie"), pick.alias("__pick"))
    names = left.columns
    l_ = left.select(*on, F.col(t).alias("__t"), F.lit(0).alias("__side"), F.lit(None).alias("__tie"), F.struct(*names).alias("__row"))
    both = r.unionByName(l_, allowMissingColumns=True)
    # Ahead is the same sort turned round: a frame up to the end of a key is computed anew for each row, one from its beginning grows.
    order = [F.desc(c) if ahead else F.asc(c) for c in ("__t", "__side", "__tie")]
    found = F.last("__pick", ignorenulls=True).over(Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__found", found).where("__row is not null")
    if within_s is not None:
        out = out.withColumn("__found", F.when(F.abs(F.col("__found.t") - F.col("__t")) <= within_s, F.col("__found")))
    return out.select("__row.*", F.col("__found.t").alias(f"{prefix}t"), *[F.col(f"__found.{v}").alias(f"{prefix}{v}") for v in values])


def nearest_in_time(left: DataFrame, right: DataFrame, on: list[str], t: str, values: list[str], within_s: int, tie: str | None = None) -> DataFrame:
    """`left` with the row of `right` nearest in time within `within_s`, the earlier of two equally near: near_<value>, near_t."""
    both = as_of(as_of(left, right, on, t, values, tie, False, within_s, "__b_"), right, on, t, values, tie, True, within_s, "__a_")
    before = F.col("__b_t").isNotNull() & (F.col("__a_t").isNull() | (F.col(t) - F.col("__b_t") <= F.col("__a_t") - F.col(t)))
    told = [F.when(before, F.col(f"__b_{v}")).otherwise(F.col(f"__a_{v}")).alias(f"near_{v}") for v in ["t", *values]]
    return both.select(*left.columns, *told)


def within_radius(points: DataFrame, places: DataFrame, radius_m: float, lat: str = "lat", lon: str = "lon", p_lat: str = "p_lat", p_lon: str = "p_lon") -> DataFrame:
    """Each point with each place at most `radius_m` away, with distance_m; `places` has other column names than `points`.

    Cells are as wide as the radius in their own band of latitude; a place looks into those around it, over the 180th meridian and the poles too."""
    size = geo.band_size(radius_m)
    cy = geo.cell(F.col(lat), size)
    p = points.withColumn("__cy", cy).withColumn("__cx", geo.band_cell(F.col(lon), geo.band_cells(cy, size, radius_m)))
    q = places.withColumn("__c", F.explode(geo.cells_near(F.col(p_lat), F.col(p_lon), size, radius_m))).select(*places.columns, "__c.*")
    # Two thirds of the pairs that share a cell lie too far apart; a chord between unit vectors, made once a row, tells that without trigonometry a pair.
    p, q = (t.withColumns({f"__{s}{i}": v for i, v in enumerate(geo.unit(F.col(y), F.col(x)))}) for t, s, y, x in ((p, "u", lat, lon), (q, "v", p_lat, p_lon)))
    chord = sum(((F.col(f"__u{i}") - F.col(f"__v{i}")) * (F.col(f"__u{i}") - F.col(f"__v{i}")) for i in range(3)), F.lit(0.0))
    d = geo.haversine(F.col(lat), F.col(lon), F.col(p_lat), F.col(p_lon))
    near = p.join(q, ["__cy", "__cx"]).where(chord <= geo.chord_square(radius_m)).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)
    return near.drop("__cy", "__cx", *(f"__{s}{i}" for s in "uv" for i in range(3)))


def nearest_k(pairs: DataFrame, key: list[str], k: int, tie: str, distance: str = "distance_m") -> DataFrame:
    """The k nearest of each key, with rank; ties by `tie`."""
    w = Window.partitionBy(*key).orderBy(distance, tie)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def snap(points: DataFrame, places: DataFrame, key: list[str], place_id: str = "place_id", accuracy: str = "accuracy", near_m: float = 75.0, least_accuracy_m: float = 30.0, apart: float = 2.0) -> DataFrame:
    """Points moved to the nearest place at most `near_m` away, if their accuracy is unknown or `least_accuracy_m` or worse and the runner-up is
    `apart` times as far or farther: snapped_place, lat, lon. `places`: place_id, p_lat, p_lon.

    The runner-up counts within `apart` times `near_m`, where it can matter."""
    names = points.columns
    pairs = nearest_k(within_radius(points, places, near_m * apart), key, 2, place_id)
    first = F.max(F.when(F.col("rank") == 1, F.struct(F.col(place_id).alias("id"), F.col("distance_m").alias("d"), F.col("p_lat").alias("y"), F.col("p_lon").alias("x"))))
    both = pairs.groupBy(*key).agg(first.alias("__1"), F.max(F.when(F.col("rank") == 2, F.col("distance_m"))).alias("__d2"))
    out = points.join(both.select(*key, *(F.col(f"__1.{c}").alias(f"__{c}") for c in ("id", "d", "y", "x")), "__d2"), key, "left")
    ok = (F.col("__d") <= near_m) & (F.col(accuracy).isNull() | (F.col(accuracy) >= least_accuracy_m)) & (F.col("__d2").isNull() | (F.col("__d2") >= apart * F.col("__d")))
    ok = F.coalesce(ok, F.lit(False))
    moved = {"lat": F.when(ok, F.col("__y")).otherwise(F.col("lat")), "lon": F.when(ok, F.col("__x")).otherwise(F.col("lon"))}
    return out.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in names], F.when(ok, F.col("__id")).alias("snapped_place"))


def edge_cells(points: DataFrame, edges: DataFrame, radius_m: float, size: float, lat: str = "lat", lon: str = "lon") -> tuple[DataFrame, DataFrame]:
    """Both with cells __cy, __cx that a point and an edge (lat1, lon1, lat2, lon2) at most `radius_m` away from it share; `size`: degrees of latitude a cell, geo.band_size() or more."""
    cells = geo.band_cells(F.col("__cy"), size, radius_m)
    e = edges.withColumn("__cy", F.explode(F.sequence(geo.cell(F.least("lat1", "lat2"), size) - 1, geo.cell(F.greatest("lat1", "lat2"), size) + 1)))
    other = F.col("lon2") + geo.around(F.col("lon2") - F.col("lon1"))
    at = lambda x: F.floor(x / 360.0 * cells)
    west, east = at(F.least("lon1", other)) - 1, at(F.greatest("lon1", other)) + 1
    e = e.withColumn("__cx", F.explode(F.array_distinct(F.transform(F.sequence(west, east), lambda x: F.pmod(x, cells)))))
    return points.withColumn("__cy", geo.cell(F.col(lat), size)).withColumn("__cx", geo.band_cell(F.col(lon), cells)), e


def near_lines(points: DataFrame, edges: DataFrame, radius_m: float, key: list[str], line_id: str = "way_id", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Each point with each line at most `radius_m` away, with the least distance_m. `edges`: way_id, lat1, lon1, lat2, lon2 and columns of the line."""
    p, e = edge_cells(points, edges, radius_m, max(geo.band_size(radius_m), 0.002), lat, lon)
    d = geo.to_segment(F.col(lat), F.col(lon), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    near = p.join(e, ["__cy", "__cx"]).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)
    rest = [c for c in edges.columns if c not in (line_id, "lat1", "lon1", "lat2", "lon2", "edge_ix")]
    return near.groupBy(*key, line_id).agg(F.min("distance_m").alias("distance_m"), *[F.first(c).alias(c) for c in rest])


def corridor(track: DataFrame, edges: DataFrame, key: list[str], step_m: float, radius_m: float, line_id: str = "way_id") -> DataFrame:
    """The lines within `radius_m` of a track (key, lat, lon, lat2, lon2 a row a leg), sampled each `step_m`: key, way_id once each."""
    n = F.greatest(F.lit(1), F.ceil(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) / step_m).cast("int"))
    at = track.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    f = F.col("__k") / F.col("__n")
    at = at.select(*key, (F.col("lat") + f * (F.col("lat2") - F.col("lat"))).alias("lat"), (F.col("lon") + f * (F.col("lon2") - F.col("lon"))).alias("lon")).distinct()
    return near_lines(at, edges, radius_m, [*key, "lat", "lon"], line_id).select(*key, line_id).distinct()


def covered(points: DataFrame, boxes: DataFrame, radius_m: float, now: Column, fresh_s: int = 180 * 86_400) -> DataFrame:
    """The points whose disc one fresh box holds whole. boxes: south, north, west, east, fetched_ts, on a grid of tenths of a degree."""
    size = 0.1
    p = points.withColumn("__disc", geo.box_around(F.col("lat"), F.col("lon"), radius_m)).withColumn("__cy", geo.cell(F.col("lat"), size)).withColumn("__cx", geo.cell(F.col("lon"), size))
    span = lambda a, b: F.explode(F.sequence(geo.cell(F.col(a), size), geo.cell(F.col(b), size)))
    b = boxes.where(now - F.col("fetched_ts") <= fresh_s).withColumn("__cy", span("south", "north")).withColumn("__cx", span("west", "east"))
    holds = geo.box_covers((b["south"], b["north"], b["west"], b["east"]), p["__disc"])
    return p.join(b, (p["__cy"] == b["__cy"]) & (p["__cx"] == b["__cx"]) & holds, "left_semi").select(*points.columns)
