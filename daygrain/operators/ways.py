"""Networks of ways: graphs, shortest paths, matching of tracks, snapping of trains, bus routes and evidence.

A leg of a journey meets the part of the network around it; matching it is a recursion in numpy, many legs a batch.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import geo
from daygrain.operators import groups
from daygrain.operators.joins import near_lines, within_radius
from daygrain.operators.track import M_PER_DEGREE, flat, haversine


def edges_of(ways: DataFrame, path: str = "path", way_id: str = "way_id") -> DataFrame:
    """The legs of ways (way_id, path: array<struct<lat, lon>>): way_id, lat1, lon1, lat2, lon2 and the other columns."""
    rest = [c for c in ways.columns if c != path]
    legs = F.when(F.size(path) > 1, F.zip_with(F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1), lambda a, b: F.struct(a["lat"].alias("lat1"), a["lon"].alias("lon1"), b["lat"].alias("lat2"), b["lon"].alias("lon2"))))
    return ways.select(*rest, F.posexplode(legs).alias("edge_ix", "e")).select(*rest, "edge_ix", "e.*")


def node_key(lat: Column, lon: Column) -> Column:
    """A node's name: coordinates to five decimals."""
    return F.format_string("%.5f,%.5f", lat, lon)


def graph_tables(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, lat, lon) and undirected edges (a, b, metres, way_id), each once."""
    e = edges.select("way_id", node_key(F.col("lat1"), F.col("lon1")).alias("a"), node_key(F.col("lat2"), F.col("lon2")).alias("b"), "lat1", "lon1", "lat2", "lon2")
    ends = e.select(F.col("a").alias("node"), F.col("lat1").alias("lat"), F.col("lon1").alias("lon")).unionByName(e.select(F.col("b").alias("node"), F.col("lat2").alias("lat"), F.col("lon2").alias("lon")))
    nodes = ends.groupBy("node").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    m = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    both = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "way_id", m.alias("metres"))
    return nodes, both.groupBy("a", "b").agg(F.min("metres").alias("metres"), F.min("way_id").alias("way_id"))


@dataclass
class Graph:
    """Legs of a region's ways, with a grid to find near ones and a list of neighbours."""

    legs: np.ndarray  # lat1, lon1, lat2, lon2
    way: list
    cell_m: float = 100.0
    nodes: dict = field(default_factory=dict)
    place: list = field(default_factory=list)
    next: dict = field(default_factory=lambda: defaultdict(list))

    def __post_init__(self) -> None:
        self.ends = np.zeros((len(self.legs), 2), int)
        grid = defaultdict(list)
        for i, (a, b, c, d) in enumerate(self.legs):
            for j, (y, x) in enumerate(((a, b), (c, d))):
                key = round(y, 5), round(x, 5)
                if key not in self.nodes:
                    self.nodes[key] = len(self.place)
                    self.place.append((y, x))
                self.ends[i, j] = self.nodes[key]
            u, v = self.ends[i]
            m = float(haversine(a, b, c, d))
            self.next[u].append((v, m, i))
            self.next[v].append((u, m, i))
            for cy in range(self._c(min(a, c)), self._c(max(a, c)) + 1):
                for cx in range(self._c(min(b, d)), self._c(max(b, d)) + 1):
                    grid[cy, cx].append(i)
        self.grid = {k: np.asarray(v) for k, v in grid.items()}

    def _c(self, deg: float) -> int:
        return math.floor(deg * M_PER_DEGREE / self.cell_m)

    def near(self, lat: float, lon: float, radius_m: float, most: int) -> list[tuple[float, int, float]]:
        """(metres, leg, share of the leg) of the nearest legs within the radius."""
        k, kx = math.ceil(radius_m / self.cell_m), math.ceil(radius_m / self.cell_m / max(0.05, math.cos(math.radians(lat))))
        cy, cx = self._c(lat), self._c(lon)
        found = [self.grid[y, x] for y in range(cy - k, cy + k + 1) for x in range(cx - kx, cx + kx + 1) if (y, x) in self.grid]
        if not found:
            return []
        at = np.unique(np.concatenate(found))
        d, f = project(lat, lon, self.legs[at])
        order = np.lexsort((at, d))[:most]
        return [(float(d[i]), int(at[i]), float(f[i])) for i in order if d[i] <= radius_m]

    def length(self, leg: int) -> float:
        return float(haversine(*self.legs[leg]))

    def point(self, leg: int, f: float) -> tuple[float, float]:
        a, b, c, d = self.legs[leg]
        return a + f * (c - a), b + f * (d - b)

    def paths(self, start: int, goals: set[int], limit_m: float, cost=None) -> dict[int, tuple[float, list[int]]]:
        """Dijkstra from a node: goal -> (metres, nodes on the way), within the limit. cost(leg, metres): what a leg counts, its length if None."""
        best, came, heap, out = {start: 0.0}, {}, [(0.0, start)], {}
        while heap and len(out) < len(goals):
            d, u = heapq.heappop(heap)
            if d > best.get(u, math.inf):
                continue
            if u in goals and u not in out:
                nodes, x = [u], u
                while x != start:
                    x = came[x]
                    nodes.append(x)
                out[u] = d, nodes[::-1]
            for v, m, leg in self.next[u]:
                n = d + (m if cost is None else cost(leg, m))
                if n <= limit_m and n < best.get(v, math.inf):
                    best[v], came[v] = n, u
                    heapq.heappush(heap, (n, v))
        return out


def project(lat: float | np.ndarray, lon: float | np.ndarray, legs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of a point, or of [points, 1], from legs, in metres, and where on each leg the nearest point lies, 0 to 1."""
    k = np.cos(np.radians(lat)) * M_PER_DEGREE
    ax, ay, bx, by = (legs[:, 1] - lon) * k, (legs[:, 0] - lat) * M_PER_DEGREE, (legs[:, 3] - lon) * k, (legs[:, 2] - lat) * M_PER_DEGREE
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    f = np.clip(np.where(n > 0, -(ax * dx + ay * dy) / np.where(n > 0, n, 1), 0), 0, 1)
    return np.hypot(ax + f * dx, ay + f * dy), f


@dataclass(frozen=True)
class Profile:
    radius_m: float
    candidates: int
    sigma_m: float
    beta_m: float
    detour: float


ROAD = Profile(50.0, 5, 12.0, 10.0, 1.8)
WALK = Profile(20.0, 6, 8.0, 12.0, 1.4)


def match(graph: Graph, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, profile: Profile) -> list[tuple[float, float, float]] | None:
    """The path on the network, as (lat, lon, time), of a track: Viterbi over candidate legs, a Gaussian of the distance and an exponential of the detour.

    None where a fix has no way to the next, or the path is longer than `detour` times the track."""
    layers = [(i, graph.near(lat[i], lon[i], profile.radius_m, profile.candidates)) for i in range(len(t))]
    layers = [(i, c) for i, c in layers if c]
    if len(layers) < 2:
        return None
    score = [-(d**2) / (2 * profile.sigma_m**2) for d, _, _ in layers[0][1]]
    back: list[list[tuple[int, list[int]] | None]] = []
    for (i, here), (j, there) in zip(layers, layers[1:], strict=False):
        straight = float(haversine(lat[i], lon[i], lat[j], lon[j]))
        limit = straight * 4 + 400
        goals = {int(n) for _, leg, _ in there for n in graph.ends[leg]}
        ways = {}
        for a, (_, leg, f) in enumerate(here):
            u, v = (int(n) for n in graph.ends[leg])
            m = graph.length(leg)
            for node, part in ((u, f * m), (v, (1 - f) * m)):
                if (a, node) not in ways:
                    ways[a, node] = part, graph.paths(node, goals, limit)
        new, via = [], []
        for d, leg, f in there:
            u, v = (int(n) for n in graph.ends[leg])
            m = graph.length(leg)
            best, how = -math.inf, None
            for a, (_, leg_a, f_a) in enumerate(here):
                options = [(abs(f - f_a) * m, [])] if leg == leg_a else []
                for node in {int(n) for n in graph.ends[leg_a]}:
                    part, reached = ways[a, node]
                    for end, rest in ((u, f * m), (v, (1 - f) * m)):
                        if end in reached:
                            options.append((part + reached[end][0] + rest, reached[end][1]))
                if options and score[a] > -math.inf:
                    route, nodes = min(options, key=lambda o: o[0])
                    s = score[a] - abs(route - straight) / profile.beta_m
                    if s > best:
                        best, how = s, (a, nodes)
            new.append(best - d**2 / (2 * profile.sigma_m**2))
            via.append(how)
        if max(new) == -math.inf:
            return None
        score = new
        back.append(via)
    k = int(np.argmax(score))
    i, c = layers[-1]
    rest = [(*graph.point(c[k][1], c[k][2]), float(t[i]))]
    for n in range(len(back) - 1, -1, -1):
        a, nodes = back[n][k]
        i, c = layers[n]
        inner = [(*graph.place[x], math.nan) for x in nodes]
        rest = [(*graph.point(c[a][1], c[a][2]), float(t[i])), *inner, *rest]
        k = a
    path = interpolate(dedupe(rest))
    y, x = np.asarray([p[0] for p in path]), np.asarray([p[1] for p in path])
    own = haversine(lat[:-1], lon[:-1], lat[1:], lon[1:]).sum()
    if haversine(y[:-1], x[:-1], y[1:], x[1:]).sum() > profile.detour * own + 100:
        return None
    return path


def dedupe(path: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for p in path:
        if out and p[:2] == out[-1][:2]:
            if math.isnan(out[-1][2]):
                out[-1] = p
            continue
        out.append(p)
    return out


def interpolate(path: list[tuple]) -> list[tuple]:
    """Times of points without one, by the length of the path between those with."""
    if not path:
        return path
    y, x, t = (np.asarray([p[i] for p in path], float) for i in range(3))
    at = np.append(0, np.cumsum(haversine(y[:-1], x[:-1], y[1:], x[1:])))
    known = ~np.isnan(t)
    return list(zip(y.tolist(), x.tolist(), np.interp(at, at[known], t[known]).tolist(), strict=True)) if known.any() else path


def simplify(lat: np.ndarray, lon: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Which points a line keeps so that the others lie within the tolerance of it; the first and last stay."""
    keep = np.zeros(len(lat), bool)
    if len(lat):
        keep[[0, -1]] = True
    stack = [(0, len(lat) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        leg = np.array([[lat[a], lon[a], lat[b], lon[b]]])
        d = np.array([project(lat[i], lon[i], leg)[0][0] for i in range(a + 1, b)])
        if d.max() > tolerance_m:
            k = a + 1 + int(d.argmax())
            keep[k] = True
            stack += [(a, k), (k, b)]
    return np.flatnonzero(keep)


def reject_spikes(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, far_m: float = 200.0) -> np.ndarray:
    """Without points far from both neighbours that themselves are close."""
    keep = np.ones(len(t), bool)
    for i in range(1, len(t) - 1):
        a, b, c = haversine(lat[i - 1], lon[i - 1], lat[i], lon[i]), haversine(lat[i], lon[i], lat[i + 1], lon[i + 1]), haversine(lat[i - 1], lon[i - 1], lat[i + 1], lon[i + 1])
        keep[i] = not (min(a, b) > far_m and c < min(a, b) / 2)
    return np.flatnonzero(keep)


def remove_spurs(path: list[tuple]) -> list[tuple]:
    """Without there-and-back stubs: where a path returns to the point before last."""
    out: list[tuple] = []
    for p in path:
        if len(out) > 1 and out[-2][:2] == p[:2]:
            out.pop()
            continue
        out.append(p)
    return out


def off_network(graph: Graph, lat: np.ndarray, lon: np.ndarray, near_m: float) -> float:
    """The share of points without a leg within `near_m`."""
    return float(np.mean([not graph.near(a, b, near_m, 1) for a, b in zip(lat, lon, strict=True)])) if len(lat) else 0.0


def snap_train(graph: Graph, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, near_m: float = 500.0, most: float = 25.0) -> list[tuple[float, float, float]] | None:
    """The way of a train on rails from its first to its last fix; legs far from the fixes count up to 25 times their length."""
    a, b = graph.near(lat[0], lon[0], near_m, 1), graph.near(lat[-1], lon[-1], near_m, 1)
    if not a or not b:
        return None
    mid = {}

    def cost(leg: int, m: float) -> float:
        if leg not in mid:
            y, x = graph.point(leg, 0.5)
            d = float(flat(y, x, lat, lon).min())
            mid[leg] = 1.0 if d <= 150 else most if d >= near_m else 1 + (most - 1) * (d - 150) / (near_m - 150)
        return m * mid[leg]

    start, goal = int(graph.ends[a[0][1]][round(a[0][2])]), int(graph.ends[b[0][1]][round(b[0][2])])
    found = graph.paths(start, {goal}, math.inf, cost)
    if goal not in found:
        return None
    nodes = [graph.place[n] for n in found[goal][1]]
    return interpolate(dedupe([(*graph.point(a[0][1], a[0][2]), float(t[0])), *((y, x, math.nan) for y, x in nodes), (*graph.point(b[0][1], b[0][2]), float(t[-1]))]))


PATH = "array<struct<lat:double,lon:double,t:double>>"


def legs_around(fixes: DataFrame, keys: list[str], edges: DataFrame, profile: Profile, cell_deg: float) -> DataFrame:
    """keys, way_id, lat1, lon1, lat2, lon2: the legs that match() may come to from a key's fixes (t, lat, lon), each once.

    From a fix near a leg it looks no farther than four times the way to the next such fix and 400 m, from the leg's ends on; so the legs in the box of a key's
    fixes, widened by that, the leg's length and the radius, are enough. Boxes and legs meet in cells of cell_deg degrees, doubled as often as a box
    needs to lie in a few; they set the cost and not the result."""
    leg = ["way_id", "lat1", "lon1", "lat2", "lon2"]
    at = [*keys, "t", "lat", "lon"]
    told = edges.select(F.struct(*leg).alias("way_id"), *leg[1:], geo.haversine(*(F.col(c) for c in leg[1:])).alias("leg_m"))
    near = near_lines(fixes.select(*at), told, profile.radius_m * 1.01 + 1, at).groupBy(*at).agg(F.max("leg_m").alias("leg_m"))
    w = Window.partitionBy(*keys).orderBy("t", "lat", "lon")
    step = lambda f: F.when(f("t").over(w).isNotNull(), geo.haversine(F.col("lat"), F.col("lon"), f("lat").over(w), f("lon").over(w)))
    straight = F.coalesce(F.greatest(step(F.lead), step(F.lag)), F.lit(0.0))
    disc = near.withColumn("__b", geo.box_around(F.col("lat"), F.col("lon"), 1.05 * (4 * straight + 400 + F.col("leg_m") + profile.radius_m)))
    box = disc.groupBy(*keys).agg(F.min("__b.south").alias("s"), F.max("__b.north").alias("n"), F.min("__b.west").alias("w"), F.max("__b.east").alias("e"))
    wide = F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w")) / (4 * cell_deg)
    box = box.withColumn("__level", F.least(F.lit(LEVELS - 1), F.greatest(F.lit(0), F.ceil(F.log2(wide)).cast("int"))))

    def cells(df: DataFrame, south: Column, north: Column, west: Column, east: Column) -> DataFrame:
        size = F.lit(cell_deg) * F.pow(F.lit(2.0), F.col("__level"))
        span = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
        return df.withColumn("__cy", span(south, north)).withColumn("__cx", span(west, east))

    tiles = cells(box, F.col("s"), F.col("n"), F.col("w"), F.col("e"))
    levels = edges.select(*leg).withColumn("__level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    placed = cells(levels, F.least("lat1", "lat2"), F.greatest("lat1", "lat2"), F.least("lon1", "lon2"), F.greatest("lon1", "lon2"))
    both = tiles.join(placed, ["__level", "__cy", "__cx"])
    inside = (F.greatest("lat1", "lat2") >= F.col("s")) & (F.least("lat1", "lat2") <= F.col("n")) & (F.greatest("lon1", "lon2") >= F.col("w")) & (F.least("lon1", "lon2") <= F.col("e"))
    return both.where(inside).select(*keys, *leg).distinct()


#: Sizes of cells in which networks are found: the smallest, and doubled each time.
LEVELS = 12


@functools.lru_cache(maxsize=64)
def _graph(legs: bytes) -> Graph:
    """A worker's last networks: days of one place meet the same legs."""
    rows = np.frombuffer(legs).reshape(-1, 4)
    return Graph(rows, list(range(len(rows))))


def match_legs(fixes: DataFrame, keys: list[str], edges: DataFrame, profile: Profile = ROAD, cell_deg: float = 0.05) -> DataFrame:
    """Per leg of a journey (keys; fixes t, lat, lon) its matched path on the network (edges: way_id, lat1, lon1, lat2, lon2), null where there is none.

    A leg meets the part of the network around it in one aggregate, a row a leg; no task holds a region. Legs far from any edge meet none. Networks and legs that cross the
    180th meridian aren't joined there."""
    leg = ["way_id", "lat1", "lon1", "lat2", "lon2"]
    around = legs_around(fixes, keys, edges, profile, cell_deg).select(*keys, F.struct(*leg).alias("__leg"))
    rows = fixes.select(*keys, F.struct("t", "lat", "lon").alias("__fix")).unionByName(around, allowMissingColumns=True)
    whole = groups.dealt(rows, keys).groupBy(*keys).agg(F.sort_array(F.collect_list("__fix")).alias("__fix"), F.sort_array(F.collect_list("__leg")).alias("__leg")).where(F.size("__fix") > 0)

    def work(*columns: pd.Series) -> pd.Series:
        def one(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, *ends: np.ndarray) -> list[dict] | None:
            p = match(_graph(np.stack(ends, 1).astype(float).tobytes()), t.astype(float), lat.astype(float), lon.astype(float), profile) if len(ends[0]) else None
            return None if p is None else [{"lat": a, "lon": b, "t": c} for a, b, c in p]

        return pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object)

    told = F.pandas_udf(work, PATH)(*(F.col(f"__fix.{c}") for c in ("t", "lat", "lon")), *(F.col(f"__leg.{c}") for c in leg[1:]))
    return whole.select(*keys, told.alias("path"))


def stations_on_line(stations: DataFrame, edges: DataFrame, near_m: float = 300.0) -> DataFrame:
    """Stations (name, p_lat, p_lon) within `near_m` of a line's legs (line, lat1, ...): line and name once each, with the least distance."""
    s = stations.withColumnsRenamed({"p_lat": "lat", "p_lon": "lon"})
    n = near_lines(s, edges.withColumnRenamed("line", "way_id").select("way_id", "lat1", "lon1", "lat2", "lon2"), near_m, ["name", "lat", "lon"])
    return n.groupBy(F.col("way_id").alias("line"), "name").agg(F.min("distance_m").alias("distance_m"))


def stop_counts(order: list[list[str]], board: str, alight: str) -> list[int]:
    """How many stops lie between two stations, on each pattern that serves both in either order."""
    return sorted({abs(p.index(alight) - p.index(board)) - 1 for p in order if board in p and alight in p and board != alight})


def line_by_stops(patterns: dict[str, list[list[str]]], board: str, alight: str, seen: int) -> str | None:
    """The line whose number of stops fits the standstills seen best, if only one does."""
    fit = {line: min((abs(n - seen) for n in stop_counts(p, board, alight)), default=None) for line, p in patterns.items()}
    known = sorted((d, line) for line, d in fit.items() if d is not None)
    return known[0][1] if known and (len(known) == 1 or known[1][0] > known[0][0]) else None


def bus_evidence(legs: DataFrame) -> DataFrame:
    """nats and is_bus per ride: waits_at_stop (a wait of 45 s at a stop before it), stop_dwells, signal_stop_dwells, other_dwells."""
    n = (
        F.when(F.col("waits_at_stop"), 1.5).otherwise(0.0) + F.least(F.lit(2.4), 0.8 * F.col("stop_dwells")) + 0.4 * F.col("signal_stop_dwells")
        - F.when((F.col("other_dwells") >= 3) & (F.col("stop_dwells") == 0), 0.8).otherwise(0.0)
    )
    return legs.withColumn("nats", n).withColumn("is_bus", F.col("nats") >= 2.0)


def dwells(track: DataFrame, keys: list[str], slow_kmh: float = 3.0, least_s: int = 20) -> DataFrame:
    """Standstills in a ride: runs of hops below 3 km/h of 20 s or longer: start_ts, end_ts, lat, lon."""
    from daygrain.operators.series import hops, islands

    h = hops(track, keys, ["t"]).withColumn("slow", F.coalesce(F.col("hop_kmh") < slow_kmh, F.lit(False)))
    i = islands(h, keys, ["t"], ["slow"]).where("slow")
    out = i.groupBy(*keys, "island").agg((F.min(F.col("t") - F.col("gap_s"))).alias("start_ts"), F.max("t").alias("end_ts"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return out.where(F.col("end_ts") - F.col("start_ts") >= least_s).drop("island")


def bus_routes(rides: DataFrame, track: DataFrame, stops: DataFrame, key: str = "ride_id", anchor_m: float = 120.0, least: float = 0.6) -> DataFrame:
    """The best route of each ride: ends within 120 m of stops in the route's order, the share of stops between that the track passes, times how
    plausible the speed is. rides: ride_id, lat1, lon1, lat2, lon2, avg_speed; track: ride_id, lat, lon; stops: route, seq, s_lat, s_lon."""
    s = stops.withColumnsRenamed({"s_lat": "p_lat", "s_lon": "p_lon"})
    one = within_radius(rides.select(key, F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), s, anchor_m).groupBy(key, "route").agg(F.min_by("seq", F.struct("distance_m", "seq")).alias("a"))
    two = within_radius(rides.select(key, F.col("lat2").alias("lat"), F.col("lon2").alias("lon")), s, anchor_m).groupBy(key, "route").agg(F.min_by("seq", F.struct("distance_m", "seq")).alias("b"))
    pairs = one.join(two, [key, "route"]).where("a < b")
    between = pairs.join(stops, "route").where("seq > a and seq < b").select(key, "route", "seq")
    passed = within_radius(track.select(key, "lat", "lon"), s, 60.0).select(key, "route", "seq").distinct().withColumn("hit", F.lit(1))
    share = between.join(passed, [key, "route", "seq"], "left").groupBy(key, "route").agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("coverage"))
    out = pairs.join(share, [key, "route"], "left").join(rides.select(key, "avg_speed"), key)
    out = out.withColumn("score", F.coalesce("coverage", F.lit(1.0)) / (1 + F.exp((F.col("avg_speed") - 38) / 6)))
    best = out.where(F.col("score") >= least).groupBy(key).agg(F.max_by(F.struct("route", "score", "a", "b"), F.struct("score", F.col("route"))).alias("r"))
    return best.select(key, "r.*")


def proximity(fixes: DataFrame, rail: DataFrame, road: DataFrame, keys: list[str], radius_m: float = 300.0) -> DataFrame:
    """rail_m and road_m of each point, null beyond the radius."""
    point = [*keys, "lat", "lon"]
    near = lambda e, n: near_lines(fixes, e, radius_m, point).groupBy(*point).agg(F.min("distance_m").alias(n))
    return fixes.join(near(rail, "rail_m"), point, "left").join(near(road, "road_m"), point, "left")


def regions(boxes: pd.DataFrame, gap_deg: float) -> np.ndarray:
    """Groups of boxes (south, north, west, east) that lie within a gap of each other, directly or by way of others."""
    of = np.arange(len(boxes))
    s, n, w, e = (boxes[c].to_numpy(float) for c in ("south", "north", "west", "east"))
    for i in range(len(boxes)):
        near = (s <= n[i] + gap_deg) & (n >= s[i] - gap_deg) & (w <= e[i] + gap_deg) & (e >= w[i] - gap_deg)
        groups = np.unique(of[near])
        of[np.isin(of, groups)] = groups.min()
    return np.unique(of, return_inverse=True)[1]


def in_ring(lat: float, lon: float, ring: list[tuple[float, float]]) -> bool:
    """Whether a point is in a closed ring, by casting a ray."""
    inside = False
    for (y1, x1), (y2, x2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def smooth_walk(lat: np.ndarray, lon: np.ndarray, acc: np.ndarray, weight: float = 4.0, rounds: int = 60) -> np.ndarray:
    """A walk drawn smoothly: the path that is closest to its fixes (by accuracy) and bends least, by conjugate gradients. Columns lat, lon."""
    if len(lat) < 3:
        return np.stack([lat, lon], 1)
    w = 1 / np.maximum(acc, 3.0) ** 2
    w = w / w.mean()

    def times(x: np.ndarray) -> np.ndarray:
        bend = x[:-2] - 2 * x[1:-1] + x[2:]
        out = w[:, None] * x
        out[:-2] += weight * bend
        out[1:-1] -= 2 * weight * bend
        out[2:] += weight * bend
        return out

    z = np.stack([lat, lon], 1)
    centre = z.mean(0)
    target = w[:, None] * (z - centre)
    x = z - centre
    r = target - times(x)
    p, rr = r.copy(), (r * r).sum()
    for _ in range(rounds):
        if rr < 1e-24:
            break
        q = times(p)
        a = rr / (p * q).sum()
        x, r = x + a * p, r - a * q
        new = (r * r).sum()
        p, rr = r + new / rr * p, new
    return x + centre
