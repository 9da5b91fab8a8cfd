"""Decoding with the track: a ride on a line is scored by the best way over the line's edges, and that score goes into the day's semi-Markov recursion.

Two levels of the same recursion. The inner one has a line's edges as states: at each step a train stays on its edge or goes to one that shares an end with it, and the
fix, or that there is none, is told by each edge. It gives a score to every window of steps at once. The outer one is the decoder of a day, in
which a segment of a line's state adds the window's score.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.operators import groups, hsmm
from daygrain.operators.context import chain_scores, segment_scores
from daygrain.operators.joins import near_lines
from daygrain.operators.ways import project

#: Fixed values. Metres of a fix from the track: deviation above and below ground. Nats: of a fix on the track, of none below and above ground; and the least of a step.
SURFACE_M, UNDERGROUND_M = 30.0, 150.0
SEEN, UNSEEN_BELOW, UNSEEN_ABOVE, LEAST = 2.3, 1.5, -2.5, -2000.0
#: Metres from the fix before a window, or after it, to the edges where it may begin or end; metres within which a line is there at all. Minutes of a ride.
BOUNDARY_M, PRESENT_M, RIDE_MIN = 600.0, 1500.0, 90


def edge_nats(lat: np.ndarray, lon: np.ndarray, legs: np.ndarray, underground: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[steps, edges], or [days, steps, edges]: nats of each step's fix (NaN: none) on each edge, and its distance (infinite without a fix)."""
    nats = np.broadcast_to(np.where(underground, UNSEEN_BELOW, UNSEEN_ABOVE).astype(float), (*lat.shape, len(legs))).copy()
    far = np.full(nats.shape, np.inf)
    sigma = np.where(underground, UNDERGROUND_M, SURFACE_M)
    seen = ~np.isnan(lat)
    far[seen], _ = project(lat[seen][:, None], lon[seen][:, None], legs)
    nats[seen] = np.maximum(LEAST, SEEN - 0.5 * (far[seen] / sigma) ** 2)
    return nats, far


def neighbours(legs: np.ndarray) -> np.ndarray:
    """[edges, most neighbours]: the edges that share an end with each, itself first; rows are filled up with the edge itself."""
    at = defaultdict(list)
    for i, (a, b, c, d) in enumerate(legs):
        for key in {(round(a, 5), round(b, 5)), (round(c, 5), round(d, 5))}:
            at[key].append(i)
    sets = [{i} for i in range(len(legs))]
    for some in at.values():
        for i in some:
            sets[i].update(some)
    width = max(map(len, sets), default=1)
    return np.array([[i, *sorted(s - {i})] + [i] * (width - len(s)) for i, s in enumerate(sets)]).reshape(len(legs), width)


def boundaries(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[steps, edges], or [days, steps, edges]: where a window that begins at a step may begin, by the last fix until then, and where one that ends at it may end, by the
    next fix from there. All edges where there is no such fix, or none near it."""
    near, seen = far <= BOUNDARY_M, np.isfinite(far).any(-1)
    near = near | ~near.any(-1, keepdims=True)

    def carried(order: range) -> np.ndarray:
        out, last = np.ones(far.shape, bool), np.ones((*far.shape[:-2], far.shape[-1]), bool)
        for i in order:
            last = np.where(seen[..., i, None], near[..., i, :], last)
            out[..., i, :] = last
        return out

    return carried(range(far.shape[-2])), carried(range(far.shape[-2] - 1, -1, -1))


def window_scores(nats: np.ndarray, next_to: np.ndarray, entry: np.ndarray, leave: np.ndarray, most: int) -> np.ndarray:
    """[steps, most], or [days, steps, most]: the best score of a way over edges for the window of d + 1 steps that ends at each; -inf where no way leads from an entry to an
    exit, or the day is too short. All windows that are open at a step advance together, and so do all days."""
    *days, n, e = nats.shape
    out = np.full((*days, n, most), -np.inf)
    open_ = np.full((*days, most, e), -np.inf)  # by length of the window so far, the newest first
    for t in range(n):
        moved = open_[..., next_to].max(-1)
        open_[..., 1:, :] = moved[..., :-1, :] + nats[..., t, None, :]
        open_[..., 0, :] = np.where(entry[..., t, :], nats[..., t, :], -np.inf)
        out[..., t, :] = np.where(leave[..., t, None, :], open_, -np.inf).max(-1)
    return out


def window_path(nats: np.ndarray, next_to: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> tuple[list[int], float]:
    """The best way over edges through a whole window and its score: one edge a step. Ties keep the edge, then go to the smaller one."""
    best, back = np.where(entry[0], nats[0], -np.inf), []
    for t in range(1, len(nats)):
        c = best[next_to]
        k = c.argmax(1)
        back.append(next_to[np.arange(len(k)), k])
        best = c[np.arange(len(k)), k] + nats[t]
    best = np.where(leave[-1], best, -np.inf)
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(best.max())


#: Numbers that a batch of days holds in one of the recursion's arrays.
CELLS = 1 << 19


def route_days(lat: np.ndarray, lon: np.ndarray, emission: np.ndarray, lines: dict[str, tuple], places: list[int], step_s: int, place_at: dict[int, tuple[float, float]] | None = None, cadence: np.ndarray | None = None) -> list[list[tuple]]:
    """Segments of each of [days, steps] that meet the same lines: (first step, last step, state, edges a step of a ride on a line). With place_at, fixes weigh whole
    segments and what follows what, too.

    emission: [days, steps, states] of hsmm.states(places, []). lines: name -> (edge ids, legs, underground)."""
    names = sorted(lines)
    space = hsmm.states(list(places), names)
    base = emission.shape[2] - 1  # the train on an unknown line is last
    full = np.concatenate([emission[..., :base], np.repeat(emission[..., base:], len(names) + 1, 2)], 2)
    most = max(1, RIDE_MIN * 60 // step_s)
    inner = {}
    for name in names:
        _, legs, underground = lines[name]
        nats, far = edge_nats(lat, lon, legs, underground)
        inner[name] = nats, neighbours(legs), *boundaries(far)
    scores = [window_scores(*inner[name], most) for name in names]

    whole, pair = None, None
    if place_at is not None:
        fix = np.where(np.isnan(lon), np.nan, lat), lon
        whole = segment_scores(*fix, np.zeros(lat.shape) if cadence is None else cadence, space, step_s)
        pair = chain_scores(*fix, space, step_s, place_at, {name: lines[name][1] for name in names})

    def segment(t: int, d: np.ndarray) -> np.ndarray:
        out = np.zeros((len(lat), len(d), len(space))) if whole is None else whole(t, d)
        for i, s in enumerate(scores):
            out[..., base + i] += np.where(d <= most, s[:, t - 1][:, np.minimum(d, most) - 1], -np.inf)
        return out

    way, long = hsmm.transitions(space), hsmm.durations(space, step_s=step_s)
    paths, told = hsmm.semi_viterbi(full, way, long, np.full(len(space), -np.log(len(space))), segment, pair), []
    for day, path in enumerate(paths):
        out, begins = [], np.flatnonzero(np.diff(path, prepend=-1))
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(path)], strict=True):
            s = space[path[i]]
            edges = []
            if s.line is not None:
                nats, next_to, entry, leave = inner[s.line]
                ids = lines[s.line][0]
                edges = [ids[k] for k in window_path(nats[day, i:j], next_to, entry[day, i:j], leave[day, i:j])[0]]
            out.append((i, j - 1, s, edges))
        told.append(out)
    return told


def decode_routes(observed: DataFrame, keys: list[str], edges: DataFrame, places: list[int] = (), step: str = "t", step_s: int = 60, place_at: dict[int, tuple[float, float]] | None = None, fixes: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Segments of each group's observations, as hsmm.decode() has them, with rides on named lines: keys, start_ts, end_ts, mode, place, line, edges (an edge a step).

    observed: what hsmm.decode() takes, and lat, lon (null where there is no fix). edges: line, edge_id (a string), lat1, lon1, lat2, lon2, underground. A day meets the
    edges of the lines that pass within 1500 m of one of its fixes, in one join; lines that don't aren't in its states. A segment of
    a line is at most 90 minutes. place_at: as in hsmm.decode(). fixes: keys, lat, lon of the steps that have both, where they are known without the others.
    dealt: a key's rows lie in one task, as observations() leaves them; no step is shuffled then."""
    kinds = {f.name: f.dataType.simpleString() for f in observed.schema}
    seen = (observed if fixes is None else fixes).where("lat is not null and lon is not null").select(*keys, F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon")).distinct()
    # Lines about each point of the grid, whichever days went there. Spark takes a day's steps for fewer than they are, and would send them through the driver to all tasks; merged, they never go there.
    near = near_lines(seen.select("lat", "lon").distinct().hint("merge"), edges.select(F.col("line").alias("way_id"), "lat1", "lon1", "lat2", "lon2"), PRESENT_M, ["lat", "lon"])
    there = seen.hint("merge").join(near.select("lat", "lon", F.col("way_id").alias("line")), ["lat", "lon"]).select(*keys, "line").distinct()
    leg = ["edge_id", "lat1", "lon1", "lat2", "lon2", "underground"]
    legs = edges.groupBy("line").agg(F.sort_array(F.collect_list(F.struct(*leg))).alias("legs"))
    nets = there.hint("merge").join(legs, "line").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line", "legs"))).alias("nets"))
    space = hsmm.states(list(places), [])
    told = [F.col(step).cast("long").alias("t"), "lat", "lon", F.col("cadence").cast("double").alias("cadence"), F.array(*hsmm.state_emissions(observed, space, keys, step)).alias("emission")]
    rows = (observed if dealt else groups.dealt(observed, keys)).select(*keys, F.struct(*told).alias("step"))
    days = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("step")).alias("steps"))
    days = days.hint("merge").join(nets.select(*(F.col(k).alias(f"__{k}") for k in keys), "nets"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").select(*keys, "steps", "nets", F.to_json("nets.line").alias("lines"))
    names = [*keys, "start_ts", "end_ts", "mode", "place", "line", "edges"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start_ts long, end_ts long, mode string, place long, line string, edges array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).combine_chunks()
            steps = table.column("steps").combine_chunks()
            flat, bounds = steps.flatten(), np.append(0, np.cumsum(steps.value_lengths().to_numpy(zero_copy_only=False)))
            t, lat, lon, cadence = (flat.field(c).to_numpy(zero_copy_only=False).astype(kind) for c, kind in (("t", int), ("lat", float), ("lon", float), ("cadence", float)))
            nats = flat.field("emission").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(space))
            lengths, sets = np.diff(bounds), table.column("lines").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            for which, n in sorted(set(zip(sets.tolist(), lengths.tolist(), strict=True))):
                of = np.flatnonzero((sets == which) & (lengths == n))
                net = {x["line"]: x["legs"] for x in table.column("nets")[int(of[0])].as_py() or []}
                lines = {k: ([e["edge_id"] for e in v], np.array([[e[c] for c in leg[1:5]] for e in v], float), np.array([bool(e["underground"]) for e in v])) for k, v in net.items()}
                wide = max([(len(space) + len(lines)) * max(1, min(n, hsmm.MOST_MINUTES)), *(len(v) * max(n, 8 * max(1, RIDE_MIN * 60 // step_s)) for v in net.values())])
                some = max(1, CELLS // wide)
                for i in range(0, len(of), some):
                    days_ = of[i : i + some]
                    at = bounds[days_, None] + np.arange(n)
                    found = route_days(lat[at], lon[at], nats[at], lines, list(places), step_s, place_at, cadence[at])
                    out = [(d, t[bounds[d] + a], t[bounds[d] + b] + step_s, s.mode, s.place, s.line, e) for d, segments in zip(days_.tolist(), found, strict=True) for a, b, s, e in segments]
                    day, *columns = zip(*out, strict=True)
                    kinds_ = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.string())
                    yield from pa.table([*(table.column(k).take(pa.array(day)) for k in keys), *(pa.array(c, kind) for c, kind in zip(columns, kinds_, strict=True))], names=names).to_batches()

    return days.mapInArrow(run, schema)
