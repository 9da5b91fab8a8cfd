"""Rides on rails: candidates from sparse fixes, and the stations of successive rides scored together.

A network is three tables: stations (station_id, name, p_lat, p_lon), edges (line, edge_id, lat1, lon1, lat2, lon2: legs of each line, joined where their ends
are equal) and what network() derives from both. A line is one kernel's group; everything that concerns fixes is joins by cells, windows and
aggregates, and the last step, a recursion along a day's rides, is one kernel a day over a bounded number of pairs of stations.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.cluster import staged
from daygrain.functions import geo
from daygrain.operators import groups
from daygrain.operators.joins import edge_cells, near_lines, nearest_in_time, within_radius
from daygrain.operators.track import haversine

#: Fixed values. Metres within which a line passes a station, and an edge's end belongs to it.
ON_LINE_M, FOOTPRINT_M = 250.0, 200.0
#: Km/h of a ride on average and at its peak; minutes of a window at least and at most; metres between the fixes about a hop of one stop.
AVERAGE_KMH, PEAK_KMH, SHORT_MIN, LONG_MIN, HOP_M = 12.0, 25.0, 2, 90, 400.0
DAY_MIN = 1440


# --- the network


@dataclass(frozen=True)
class Network:
    """stations; edges; stops (line, station_id): lines that pass a station; reach (line, station_id, edge_id, d1, d2): metres along the line from a station to
    both ends of an edge; paths (line, from_id, to_id, path_m): metres between stations that the line joins."""

    stations: DataFrame
    edges: DataFrame
    stops: DataFrame
    reach: DataFrame
    paths: DataFrame


def _distances(rows: pd.DataFrame) -> tuple[list, dict, dict]:
    """A line's edges as (edge_id, a, b, metres), the ends of its edges by station, and metres to each node from each station."""
    nodes: dict[tuple, int] = {}
    key = lambda y, x: nodes.setdefault((round(y, 5), round(x, 5)), len(nodes))
    edges, next_, at = [], defaultdict(list), defaultdict(set)
    for r in rows[rows.station_id.isna()].itertuples():
        a, b = key(r.lat1, r.lon1), key(r.lat2, r.lon2)
        m = float(haversine(r.lat1, r.lon1, r.lat2, r.lon2))
        edges.append((r.edge_id, a, b, m))
        next_[a].append((b, m))
        next_[b].append((a, m))
    for r in rows[rows.station_id.notna()].itertuples():
        at[r.station_id].add(key(r.lat1, r.lon1))
    found = {}
    for s, starts in at.items():
        best, heap = dict.fromkeys(starts, 0.0), [(0.0, n) for n in sorted(starts)]
        while heap:
            d, n = heapq.heappop(heap)
            if d > best[n]:
                continue
            for v, m in next_[n]:
                if d + m < best.get(v, math.inf):
                    best[v] = d + m
                    heapq.heappush(heap, (d + m, v))
        found[s] = best
    return edges, at, found


def network(stations: DataFrame, edges: DataFrame) -> Network:
    """What a region's stations and lines are to each other. Edges are straight; a line lies in one group with the stations that it passes."""
    kind = stations.schema["station_id"].dataType.simpleString()
    edge_kind = edges.schema["edge_id"].dataType.simpleString()
    s = stations.select("station_id", F.col("p_lat").alias("lat"), F.col("p_lon").alias("lon"))
    by_line = edges.select(F.struct("line", "edge_id").alias("way_id"), "lat1", "lon1", "lat2", "lon2")
    near = near_lines(s, by_line, ON_LINE_M, ["station_id"])
    stops = near.select(F.col("way_id.line").alias("line"), "station_id").distinct()
    ends = edges.select("line", F.explode(F.array(F.struct(F.col("lat1").alias("y"), F.col("lon1").alias("x")), F.struct(F.col("lat2").alias("y"), F.col("lon2").alias("x")))).alias("e")).select("line", F.col("e.y").alias("lat"), F.col("e.x").alias("lon")).distinct()
    foot = within_radius(ends, stations.select("station_id", "p_lat", "p_lon"), FOOTPRINT_M).join(stops, ["line", "station_id"], "left_semi")
    rows = edges.select("line", "edge_id", "lat1", "lon1", "lat2", "lon2", F.lit(None).cast(kind).alias("station_id")).unionByName(
        foot.select("line", F.lit(None).cast(edge_kind).alias("edge_id"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lit(None).cast("double").alias("lat2"), F.lit(None).cast("double").alias("lon2"), "station_id")
    )
    line_kind = edges.schema["line"].dataType.simpleString()

    def reach(g: pd.DataFrame) -> pd.DataFrame:
        legs, _, found = _distances(g)
        out = [(g.line.iloc[0], s, e, d[a], d[b]) for s, d in found.items() for e, a, b, _ in legs if a in d and b in d]
        return pd.DataFrame(out, columns=["line", "station_id", "edge_id", "d1", "d2"])

    def paths(g: pd.DataFrame) -> pd.DataFrame:
        _, at, found = _distances(g)
        out = [(g.line.iloc[0], s, o, min(d[n] for n in there if n in d)) for s, d in found.items() for o, there in at.items() if o != s and any(n in d for n in there)]
        return pd.DataFrame(out, columns=["line", "from_id", "to_id", "path_m"])

    grouped = groups.dealt(rows, ["line"]).groupBy("line")
    return Network(
        stations, edges, stops, grouped.applyInPandas(reach, f"line {line_kind}, station_id {kind}, edge_id {edge_kind}, d1 double, d2 double"),
        grouped.applyInPandas(paths, f"line {line_kind}, from_id {kind}, to_id {kind}, path_m double"),
    )


# --- candidates


def ride_windows(minutes: DataFrame, keys: list[str], start: str = "start_min", end: str = "end_min") -> DataFrame:
    """Runs of a day's observed minutes (keys; m, lat, lon, speed_kmh: one row a minute that was seen) that a train may explain.

    A minute counts if its speed does, or if the way to the next or from the last one seen, over a gap, was as fast. A run needs a peak and an
    average, observed or implied by its ends; one of a single minute needs fixes about it that lie a stop apart. Runs end after 90 minutes."""
    w = Window.partitionBy(*keys).orderBy("m")
    at = lambda f, c: f(c).over(w)
    hop = geo.haversine(at(F.lag, "lat"), at(F.lag, "lon"), F.col("lat"), F.col("lon"))
    gap = F.col("m") - at(F.lag, "m")
    fast = (gap > 1) & (hop / 1000 / (gap / 60) >= AVERAGE_KMH)
    rows = minutes.withColumn("__fast", F.coalesce(fast, F.lit(False)))
    rows = rows.withColumn("__train", (F.col("speed_kmh") >= AVERAGE_KMH) | F.col("__fast") | F.coalesce(at(F.lead, "__fast"), F.lit(False)))
    rows = rows.withColumn("__run", F.sum((~F.col("__train")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The minute before and after each, for runs of one.
    for name, f in (("b", F.lag), ("a", F.lead)):
        for c in ("m", "lat", "lon"):
            rows = rows.withColumn(f"__{name}_{c}", at(f, c))
    first, last = lambda c: F.min_by(c, "m"), lambda c: F.max_by(c, "m")
    runs = rows.where("__train").groupBy(*keys, "__run").agg(
        F.min("m").alias(start), F.max("m").alias("__end"), F.max("speed_kmh").alias("__peak"), F.avg("speed_kmh").alias("__avg"),
        geo.haversine(first("lat"), first("lon"), last("lat"), last("lon")).alias("__way"), geo.haversine(first("__b_lat"), first("__b_lon"), last("__a_lat"), last("__a_lon")).alias("__hop"),
        (last("__a_m") - first("__b_m")).alias("__hop_min"),
    )
    length = F.col("__end") - F.col(start) + 1
    is_hop = (F.col("__hop") >= HOP_M) & (F.col("__hop") / 1000 / (F.col("__hop_min") / 60) >= AVERAGE_KMH)
    implied = F.when(F.col("__end") > F.col(start), F.col("__way") / 1000 / ((F.col("__end") - F.col(start)) / 60)).otherwise(0.0)
    ok = ((length >= SHORT_MIN) | F.coalesce(is_hop, F.lit(False))) & ((F.col("__peak") >= PEAK_KMH) | (implied >= AVERAGE_KMH)) & ((F.col("__avg") >= AVERAGE_KMH) | (implied >= AVERAGE_KMH))
    return runs.where(ok).select(*keys, start, (F.col(start) + F.least(length, F.lit(LONG_MIN)) - 1).alias(end))


def train_candidates(minutes: DataFrame, keys: list[str], net: Network) -> DataFrame:
    """Rides that are possible: keys, start_min, end_min, line, board, alight (station ids). The fix nearest to the minute before a window lies within 250 m of
    the one station and that nearest to the minute after it within 250 m of the other; the line passes both and joins them."""
    windows = ride_windows(minutes, keys)
    fix = minutes.select(*keys, F.col("m").alias("at"), "lat", "lon")
    edge = lambda m, side: windows.select(*keys, "start_min", "end_min", m.alias("at"), F.lit(side).alias("side"))
    before = edge(F.greatest(F.col("start_min") - 1, F.lit(0)), "board")
    after = edge(F.least(F.col("end_min") + 1, F.lit(DAY_MIN - 1)), "alight")
    told = nearest_in_time(before.unionByName(after), fix, keys, "at", ["lat", "lon"], DAY_MIN)
    told = told.select(*keys, "start_min", "end_min", "side", F.col("near_lat").alias("lat"), F.col("near_lon").alias("lon"))
    near = within_radius(told, net.stations.select("station_id", "p_lat", "p_lon"), ON_LINE_M).select(*keys, "start_min", "end_min", "side", "station_id")
    key = [*keys, "start_min", "end_min"]
    board, alight = (near.where(F.col("side") == s).select(*key, F.col("station_id").alias(s)) for s in ("board", "alight"))
    # The line's own paths join both sides: no pair is made that no line joins.
    ways = net.paths.select("line", F.col("from_id").alias("board"), F.col("to_id").alias("alight"))
    return board.join(ways, "board").join(alight, [*key, "alight"]).select(*key, "line", "board", "alight")


# --- robust slopes


def theil_sen(t: np.ndarray, d: np.ndarray) -> tuple:
    """Slope (the median of those of all pairs at different times; 0 without any), intercept and spread (medians of what is left) of a line through points, or of each
    of [lines, points]."""
    if t.ndim == 1:
        return tuple(float(v[0]) for v in theil_sen(t[None], d[None]))
    n = t.shape[1]
    if not n:
        return (np.zeros(len(t)),) * 3
    i, j = np.triu_indices(n, 1)
    dt = t[:, j] - t[:, i]
    v = np.zeros(len(t))
    if len(i):
        with np.errstate(divide="ignore", invalid="ignore"):
            each = (d[:, j] - d[:, i]) / dt
        apart = dt != 0
        all_ = apart.all(1)
        v[all_] = np.median(each[all_], 1)
        for k in np.flatnonzero(apart.any(1) & ~all_):
            v[k] = np.median(each[k][apart[k]])
    c = np.median(d - v[:, None] * t, 1)
    return v, c, np.median(np.abs(d - (v[:, None] * t + c[:, None])), 1)


#: Pairs of points that a batch of lines holds at once.
PAIRS = 1 << 20


def slopes(points: DataFrame, keys: list[str], t: str = "t", d: str = "d") -> DataFrame:
    """Per key: n, first_t, last_t, slope, intercept, mad of theil_sen(). A key is one ride or one day: its pairs stay in one kernel, which takes
    lines of equally many points together."""
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    names = [*keys, "n", "first_t", "last_t", "slope", "intercept", "mad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups.whole(batches, keys):
            x, y = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("__t", "__d"))
            sizes, told = np.diff(bounds), np.zeros((5, len(bounds) - 1))
            for n in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == n)
                some = max(1, PAIRS // max(1, n * (n - 1) // 2))
                for i in range(0, len(of), some):
                    at = bounds[of[i : i + some], None] + np.arange(n)
                    told[:, of[i : i + some]] = x[at].min(1), x[at].max(1), *theil_sen(x[at], y[at])
            yield from pa.table([*(table.column(k).take(pa.array(bounds[:-1])) for k in keys), pa.array(sizes), *map(pa.array, told)], names=names).to_batches()

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, first_t double, last_t double, slope double, intercept double, mad double"
    rows = points.select(*keys, F.col(t).cast("double").alias("__t"), F.col(d).cast("double").alias("__d"))
    return groups.dealt(rows, keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


# --- stations of rides


@dataclass(frozen=True)
class Chain:
    """Fixed values of the station chain: metres, minutes, km/h and nats. A term is evidence and never decides alone: each has a floor."""

    sigma_m: float = 200.0
    slop_m_min: float = 500.0
    radius_m: float = 800.0
    most: int = 12
    ride_kmh: float = 32.0
    overhead_min: float = 0.8
    duration_share: float = 0.35
    duration_min: float = 2.0
    same_m: float = 250.0
    walk_m_min: float = 75.0
    walk_scale: float = 40.0
    chain_gap_s: int = 720
    pass_m: float = 300.0
    dwell_min: float = 3.0
    path_m: float = 400.0
    floor: float = -6.0
    chain_floor: float = -8.0
    margin: float = 1.0
    unobserved_min: float = 5.0
    anchor_least: float = -4.0
    off_track_m: float = 400.0
    fit_fixes: int = 4
    fit_min: float = 5.0
    fit_ahead_min: float = 4.0
    fit_sigma_m: float = 500.0
    fit_spread: float = 2.5
    fit_least: float = -1.5
    admit_min: float = 6.0
    admit_m_min: float = 1000.0
    dwell_least: float = -3.0
    not_served: float = -3.0


def _z(z: Column, floor: float) -> Column:
    return F.greatest(F.lit(floor), -0.5 * z * z)


def chain_sides(rides: DataFrame, fixes: DataFrame, keys: list[str], net: Network, served: DataFrame | None = None, c: Chain = Chain(), tie: str | None = None) -> DataFrame:
    """The stations that each ride (keys, ride, start_ts, end_ts, line) may have begun or ended at, and what speaks for each: keys, ride, start_ts, end_ts, line, side
    (board, alight), station_id, name, p_lat, p_lon, anchor, dwell, fit (null: says nothing), service, slop_min (null: no fix on that side).

    anchor: from the last fix before the ride, or the first after it, less sure the staler it is. dwell: fixes near a station long before
    the ride ends there (or after it began) tell that it only passed. fit: where the fixes on the track, as a robust line over time, are when the ride
    begins or ends. service: the line doesn't stop there. fixes: keys, t, lat, lon. served: line, name, served (see places.served).
    tie: a column of fixes; of those of one time the one where it is smallest counts."""
    one = _sides(rides, fixes, keys, net, c, tie=tie)
    one = one.withColumn("service", F.lit(0.0)) if served is None else _served(one, served, c)
    return one.select(*keys, "ride", "start_ts", "end_ts", "line", "side", "station_id", "name", "p_lat", "p_lon", "anchor", "dwell", "fit", "service", "slop_min")


def _served(sides: DataFrame, served: DataFrame, c: Chain) -> DataFrame:
    known = served.select("line", "name", "served").distinct()
    return sides.join(known, ["line", "name"], "left").withColumn("service", F.when(~F.col("served"), c.not_served).otherwise(0.0))


def _fits(on: pd.Series, start: pd.Series) -> pd.Series:
    """Per ride its stations' lines through the metres that its fixes (t, to: station_id, m) lie away along the track."""
    out = []
    for fixes, begin in zip(on, start, strict=True):
        told = defaultdict(list)
        for x in [] if fixes is None else fixes:
            for y in x["to"]:
                told[y["station_id"]].append(((x["t"] - begin) / 60, y["m"]))
        rows = []
        for station, points in told.items():
            t, d = np.array(points).T
            rows.append((station, len(t), t.min(), t.max(), *theil_sen(t, d)))
        out.append([dict(zip(("station_id", "n", "first_t", "last_t", "slope", "intercept", "mad"), r, strict=True)) for r in rows])
    return pd.Series(out, dtype=object)


def _sides(rides: DataFrame, fixes: DataFrame, keys: list[str], net: Network, c: Chain, ways: bool = False, tie: str | None = None) -> DataFrame:
    """chain_sides() without service. Fixes and rides travel once each, to the task of their key; there the rides find their fixes, and what their line knows comes to them.
    ways: with the line's paths in a ride's first row. A key's rows lie in one task."""
    kind = net.stations.schema["station_id"].dataType.simpleString()
    ride = [*keys, "ride"]
    # Written, so that Spark knows how small they are, and doesn't send rides or fixes to all tasks instead.
    of_line = net.stops.join(net.stations, "station_id").select("line", "station_id", "name", "p_lat", "p_lon").where("name is not null")
    lines = of_line.groupBy("line").agg(F.collect_list(F.struct("station_id", "name", "p_lat", "p_lon")).alias("__all"))
    if ways:
        joined = net.paths.where(F.col("path_m") >= c.path_m).groupBy("line").agg(F.collect_list(F.struct("from_id", "to_id", "path_m")).alias("__ways"))
        lines = lines.join(joined, "line", "left")
    lines = staged(lines, "lines")
    reach = net.reach.groupBy("line", "edge_id").agg(F.collect_list(F.struct("station_id", "d1", "d2")).alias("__reach"))
    edges = staged(net.edges.select("line", "edge_id", "lat1", "lon1", "lat2", "lon2").join(reach, ["line", "edge_id"], "left"), "edges")
    at = [F.col(x) for x in ("t", *([tie] if tie else []), "lat", "lon")]
    rows = fixes.select(*keys, F.struct(*at).alias("__f")).unionByName(rides.select(*keys, F.struct("ride", "line", "start_ts", "end_ts").alias("__r")), allowMissingColumns=True)
    day = groups.dealt(rows, keys).groupBy(*keys).agg(F.sort_array(F.collect_list("__f")).alias("__f"), F.collect_list("__r").alias("__r")).where(F.size("__r") > 0)
    if tie:
        day = day.withColumn("__f", F.filter("__f", lambda x, i: (i == 0) | (F.get("__f", i - 1)["t"] != x["t"])))
    one = day.select(*keys, "__f", F.inline("__r"))
    past, next_ = F.filter("__f", lambda x: x["t"] <= F.col("start_ts") - 1), F.filter("__f", lambda x: x["t"] >= F.col("end_ts"))
    inside = F.filter("__f", lambda x: (x["t"] >= F.col("start_ts")) & (x["t"] < F.col("end_ts")))
    one = one.select(*ride, "line", "start_ts", "end_ts", F.get(past, F.size(past) - 1).alias("b"), F.get(next_, F.lit(0)).alias("a"), inside.alias("__in"))
    one = one.select(*ride, F.struct("line", "start_ts", "end_ts", *(F.col(f"{p}.{x}").alias(f"__{p}_{x}") for p in "ba" for x in ("t", "lat", "lon"))).alias("__told"), F.posexplode_outer("__in").alias("__i", "__x"))
    # Fixes of a ride, and those on its line's track with the way along it to each station.
    one = _on_track(one.select(*ride, "__told", "__i", *(F.col(f"__x.{x}").alias(x) for x in ("t", "lat", "lon"))), edges, ride, c.off_track_m, max(geo.band_size(c.off_track_m), 0.002))
    whole = one.groupBy(*ride).agg(F.first("__told").alias("__told"), F.collect_list("__in").alias("__in"), F.array_distinct(F.collect_list("__on")).alias("__on"))
    whole = whole.select(*ride, "__told.*", "__in", "__on").join(lines, "line")
    lot = F.when(F.size("__on") >= c.fit_fixes, F.col("__on"))  # fewer fixes tell no line
    whole = whole.withColumn("__fits", F.pandas_udf(_fits, f"array<struct<station_id {kind}, n long, first_t double, last_t double, slope double, intercept double, mad double>>")(lot, F.col("start_ts")))

    def told_of(whole: DataFrame, side: str, p: str) -> tuple[DataFrame, Column]:
        whole = whole.withColumn(f"__slop_{p}", (F.col("start_ts") - F.col("__b_t") if p == "b" else F.col("__a_t") - F.col("end_ts")) / 60)
        slop = F.col(f"__slop_{p}")
        sigma = F.sqrt(F.lit(c.sigma_m**2) + F.pow(c.slop_m_min * slop, 2))

        def admits(x: Column) -> Column:
            left = (x["t"] - F.col("start_ts") if p == "b" else F.col("end_ts") - x["t"]) / 60
            return F.transform(F.filter(x["to"], lambda y: left.between(0, c.admit_min) & (y["m"] <= left * c.admit_m_min + c.radius_m)), lambda y: y["station_id"])

        def scored(x: Column) -> Column:
            near = slop.isNull() | (x["d"] <= c.radius_m + c.slop_m_min * slop)
            anchor = F.when(slop.isNull(), 0.0).otherwise(_z(x["d"] / sigma, c.floor))
            return F.struct((~near).alias("far"), (-anchor).alias("against"), x["s"]["station_id"].alias("station_id"), x["s"].alias("s"), F.array_contains(f"__admitted_{p}", x["s"]["station_id"]).alias("admitted"))

        whole = whole.withColumn(f"__admitted_{p}", F.flatten(F.transform("__on", admits)))
        metres = F.transform("__all", lambda x: F.struct(x.alias("s"), geo.haversine(F.col(f"__{p}_lat"), F.col(f"__{p}_lon"), x["p_lat"], x["p_lon"]).alias("d")))
        # One row a name: a station of several entrances is one; of those near the anchor the best dozen, and any that the track vouches for.
        whole = whole.withColumn(f"__{p}", F.sort_array(F.filter(F.transform(metres, scored), lambda x: ~x["far"] | x["admitted"])))
        whole = whole.withColumn(f"__{p}", F.filter(f"__{p}", lambda x, i: F.array_position(F.col(f"__{p}.s.name"), x["s"]["name"]) == i + 1))
        whole = whole.withColumn(f"__{p}", F.filter(f"__{p}", lambda x, i: (~x["far"] & (i < c.most)) | x["admitted"]))
        return whole, F.transform(f"__{p}", lambda x: F.struct(F.lit(side).alias("side"), x["s"].alias("s"), (-x["against"]).alias("anchor"), slop.alias("slop_min")))

    whole, boards = told_of(whole, "board", "b")
    whole, alights = told_of(whole, "alight", "a")
    first = [F.when(F.col("__i") == 0, F.col("__ways")).alias("ways")] if ways else []
    one = whole.select(*ride, "line", "start_ts", "end_ts", "__in", "__fits", *(["__ways"] if ways else []), F.posexplode(F.concat(boards, alights)).alias("__i", "__s"))
    one = one.select(*ride, "line", "start_ts", "end_ts", "__in", "__fits", *first, "__s.side", "__s.s.*", "__s.anchor", "__s.slop_min")
    # When the ride's fixes were near each.
    passed = F.transform(F.filter("__in", lambda x: geo.haversine(x["lat"], x["lon"], F.col("p_lat"), F.col("p_lon")) <= c.pass_m), lambda x: x["t"])
    one = one.withColumn("__passed", passed).withColumn("__fit", F.get(F.filter("__fits", lambda x: x["station_id"] == F.col("station_id")), 0))
    minutes, last, fit = (F.col("end_ts") - F.col("start_ts")) / 60, F.col("side") == "alight", lambda x: F.col(f"__fit.{x}")
    late = F.when(last, F.col("end_ts") - F.array_min("__passed")).otherwise(F.array_max("__passed") - F.col("start_ts")) / 60 - c.dwell_min
    ahead = F.when(last, minutes - fit("last_t")).otherwise(fit("first_t"))
    miss = F.abs(fit("slope") * F.when(last, minutes).otherwise(0.0) + fit("intercept")) / F.greatest(F.lit(c.fit_sigma_m), c.fit_spread * fit("mad"))
    told = (fit("n") >= c.fit_fixes) & (fit("last_t") - fit("first_t") >= c.fit_min) & (ahead <= c.fit_ahead_min)
    one = one.withColumn("dwell", F.coalesce(F.when(late > 0, _z(late, c.floor)), F.lit(0.0))).withColumn("fit", F.when(told, _z(miss, c.floor)))
    return one.drop("__in", "__fits", "__passed", "__fit")


def _on_track(points: DataFrame, edges: DataFrame, ride: list[str], radius_m: float, size: float) -> DataFrame:
    """The fixes of each ride (__i: their number in it; __told of the ride, with its line) as __in (null where it has none), and where an edge of its line lies within the radius, __on: t, lat, lon, and
    `to`, the metres to each station by the nearest edge. Nothing is dealt anew while edges are few."""
    p, e = edge_cells(points.withColumn("__line", F.col("__told.line")), edges.withColumnRenamed("line", "e_line"), radius_m, size)
    e = e.withColumnsRenamed({"__cy": "e_cy", "__cx": "e_cx"})
    near = p.join(e, (F.col("__cy") == F.col("e_cy")) & (F.col("__cx") == F.col("e_cx")) & (F.col("__line") == F.col("e_line")), "left")
    near = near.withColumn("__m", geo.to_segment(*(F.col(x) for x in ("lat", "lon", "lat1", "lon1", "lat2", "lon2"))))
    edge = F.when(F.col("__m") <= radius_m, F.struct("__m", "edge_id", "lat1", "lon1", "lat2", "lon2", "__reach"))
    best = near.groupBy(*ride, "__i").agg(*(F.first(x).alias(x) for x in ("__told", "t", "lat", "lon")), F.min(edge).alias("e"))
    at = [F.col(x) for x in ("lat", "lon", "e.lat1", "e.lon1", "e.lat2", "e.lon2")]
    best = best.withColumn("__length", geo.haversine(*at[2:])).withColumn("__along", geo.share_along(*at) * F.col("__length"))
    to = F.transform("e.__reach", lambda x: F.struct(x["station_id"].alias("station_id"), F.greatest(F.least(x["d1"] + F.col("__along"), x["d2"] + F.col("__length") - F.col("__along")), F.lit(0.0)).alias("m")))
    seen = ["t", "lat", "lon"]
    return best.select(*ride, "__told", F.when(F.col("t").isNotNull(), F.struct(*seen)).alias("__in"), F.when(F.col("e.__reach").isNotNull(), F.struct(*seen, to.alias("to"))).alias("__on"))


TOLD = ["station_id", "name", "p_lat", "p_lon", "anchor", "dwell", "fit", "service", "slop_min"]


def chain_pairs(told: dict[str, np.ndarray], board: dict, alight: dict, ways: list[tuple], c: Chain) -> dict[str, np.ndarray] | None:
    """Pairs of stations of one ride that its line joins (ways: from, to, metres, in order), with their score in nats: both sides' evidence, and the time that the way between
    them takes. None without any. told: chain_sides() by columns; board, alight: a station's row in them."""
    name = told["name"]
    some = [(board[x], alight[y], m) for x, y, m in ways if x in board and y in alight and name[board[x]] != name[alight[y]]]
    if not some:
        return None
    b, a, metres = (np.array(x) for x in zip(*some, strict=True))
    minutes, expected = (told["end_ts"][b[0]] - told["start_ts"][b[0]]) / 60, metres / 1000 / c.ride_kmh * 60 + c.overhead_min
    slop = told["slop_min"]
    dark = np.isnan(slop[b]) | np.isnan(slop[a]) | (slop[b] > c.unobserved_min) | (slop[a] > c.unobserved_min)
    z = (minutes - expected) / np.maximum(c.duration_min, c.duration_share * expected)
    score = np.where(dark & (expected >= minutes), 0.0, np.maximum(c.floor, -0.5 * z * z))
    for at in (b, a):
        score = score + told["anchor"][at] + told["dwell"][at] + np.nan_to_num(told["fit"][at]) + told["service"][at]
    return {f"{p}_{x}": told[x][at] for p, at in (("b", b), ("a", a)) for x in ("station_id", "name", "p_lat", "p_lon", "anchor", "dwell", "fit")} | {"score": score}


def handover(gap_min: float, y0: np.ndarray, x0: np.ndarray, n0: np.ndarray, y1: np.ndarray, x1: np.ndarray, n1: np.ndarray, c: Chain) -> np.ndarray:
    """[pairs of a ride, pairs of the next]: what it costs to go from the one's last station to the other's first in the time between them."""
    m = haversine(y0[:, None], x0[:, None], y1[None, :], x1[None, :])
    z = np.maximum(0.0, m / max(gap_min, 0.5) - c.walk_m_min) / c.walk_scale
    cost = np.maximum(c.chain_floor, -0.5 * z * z)
    return np.where((n0[:, None] == n1[None, :]) | (m <= c.same_m), 0.0, cost)


def resolve(pairs: pd.DataFrame, rides: list[tuple], c: Chain) -> list[tuple]:
    """(ride, board, alight, score, board_margin, alight_margin) of each ride of a day that has pairs; a name is None unless it is sure.

    rides: (ride, start_ts, end_ts) in order. Rides apart by more than the gap, or by one without a pair, are chains of their own. A side is sure if each
    other station makes the best chain worse by the margin, its own evidence isn't against it, and the ride didn't pass it before."""
    return chained({r: {x: g[x].to_numpy() for x in g.columns} for r, g in pairs.groupby("ride", sort=False)}, rides, c)


def chained(told: dict, rides: list[tuple], c: Chain) -> list[tuple]:
    """resolve() of pairs by ride, each as its columns."""
    chains: list[list[tuple]] = [[]]
    for r in rides:
        if chains[-1] and (r[0] not in told or r[1] - chains[-1][-1][2] > c.chain_gap_s):
            chains.append([])
        if r[0] in told:
            chains[-1].append(r)
    out = []
    for chain in chains:
        legs = [told[r[0]] for r in chain]
        own = [g["score"].astype(float) for g in legs]
        steps = [
            handover((y[1] - x[2]) / 60, *(g[f"a_{e}"].astype(k) for e, k in (("p_lat", float), ("p_lon", float), ("name", object))), *(h[f"b_{e}"].astype(k) for e, k in (("p_lat", float), ("p_lon", float), ("name", object))), c)
            for x, y, g, h in zip(chain[:-1], chain[1:], legs[:-1], legs[1:], strict=True)
        ]
        ahead, back = list(own), list(own)
        for i in range(1, len(legs)):
            ahead[i] = own[i] + (ahead[i - 1][:, None] + steps[i - 1]).max(0)
        for i in range(len(legs) - 2, -1, -1):
            back[i] = own[i] + (steps[i] + back[i + 1][None, :]).max(1)
        for r, g, o, x, y in zip(chain, legs, own, ahead, back, strict=True):
            through = x + y - o
            best = int(through.argmax())
            found = []
            for p in ("b", "a"):
                other = through[g[f"{p}_name"] != g[f"{p}_name"][best]]
                margin = float(through[best] - other.max()) if len(other) else math.inf
                anchor, dwell, fit = (g[f"{p}_{e}"][best] for e in ("anchor", "dwell", "fit"))
                sure = margin >= c.margin and (anchor > c.anchor_least or (pd.notna(fit) and fit > c.fit_least)) and dwell > c.dwell_least
                found.append((g[f"{p}_name"][best] if sure else None, margin))
            out.append((r[0], found[0][0], found[1][0], float(through[best]), found[0][1], found[1][1]))
    return out


def station_chain(rides: DataFrame, fixes: DataFrame, keys: list[str], net: Network, served: DataFrame | None = None, c: Chain = Chain()) -> DataFrame:
    """keys, ride, board, alight (names, null where unsure), score, board_margin, alight_margin: the stations of each ride on a named line that its line's stations can
    explain, all rides of a key (a day) in one recursion. Ties go to the pair with the smaller station ids."""
    kinds = {f.name: f.dataType.simpleString() for f in rides.schema}
    sides = _sides(rides, fixes, keys, net, c, ways=True)
    sides = sides.withColumn("service", F.lit(0.0)) if served is None else _served(sides, served, c)
    names = [*keys, "ride", "board", "alight", "score", "board_margin", "alight_margin"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "ride"]) + ", board string, alight string, score double, board_margin double, alight_margin double"
    numbers = ["p_lat", "p_lon", "anchor", "dwell", "fit", "service", "slop_min"]
    columns = ["ride", "start_ts", "end_ts", "line", "side", "station_id", "name", *numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict = {}  # paths by line, as they come
        for table, bounds in groups.whole(batches, keys):
            told = {x: table.column(x).to_numpy(zero_copy_only=False) for x in columns} | {x: table.column(x).to_numpy(zero_copy_only=False).astype(float) for x in numbers}
            line, ways = told["line"], table.column("ways")
            for i in np.flatnonzero(ways.is_valid().to_numpy()).tolist():
                if line[i] not in lines:
                    lines[line[i]] = sorted((x["from_id"], x["to_id"], x["path_m"]) for x in ways[i].as_py())
            ride, side, station, out = told["ride"].tolist(), told["side"].tolist(), table.column("station_id").to_pylist(), []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                order, ends = [], {}
                for i in range(lo, hi):
                    if side[i] is None:
                        order.append((ride[i], int(told["start_ts"][i]), int(told["end_ts"][i])))
                    else:
                        ends.setdefault(ride[i], {"board": {}, "alight": {}, "line": line[i]})[side[i]][station[i]] = i
                pairs = {r: chain_pairs(told, e["board"], e["alight"], lines.get(e["line"], []), c) for r, e in ends.items()}
                found = chained({r: p for r, p in pairs.items() if p is not None}, sorted(order, key=lambda x: (x[1], x[2], x[0])), c)
                out += [(lo, *x) for x in found]
            if out:
                at, *rest = zip(*out, strict=True)
                kinds_ = table.schema.field("ride").type, pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()
                yield from pa.table([*(table.column(k).take(pa.array(at)) for k in keys), *(pa.array(x, kind) for x, kind in zip(rest, kinds_, strict=True))], names=names).to_batches()

    # Pairs of stations are made in a day's own task, many days a batch, and none travels.
    rows = sides.select(*keys, *columns, "ways").unionByName(rides.select(*keys, "ride", "start_ts", "end_ts"), allowMissingColumns=True)
    return groups.dealt(rows, keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
