"""What the decoder knows of whole segments and of what follows what: the way between the fixes that bracket a segment, and where a segment begins.

Both are functions for hsmm.semi_viterbi(), over days of equal length as arrays [days, steps]; a fix that is missing is NaN. Every term is evidence with a floor, widened
by how stale its fixes are, so that it never decides alone. place_paths() is that recursion with both for places alone, and decode_fixes() makes steps, what they
tell and the decoding of days in one task, from their fixes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.operators import groups, hsmm
from daygrain.operators.hsmm import LEAST_NATS, NET_SPEED, SLOP_M_PER_MIN, STILL_M, STRIDE_M, STRIDE_SPREAD, State
from daygrain.operators.track import haversine
from daygrain.operators.ways import project

#: Metres about a place, about a line, and from which a line is as far as any.
PLACE_M, LINE_M, LINE_MISS_M = 300.0, 800.0, 5000.0
MOVING = ("walking", "cycling", "driving", "train", "plane")


def brackets(lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[days, steps + 1]: the last fix before each step (-1: none), and the first at it or behind (steps: none)."""
    n = lat.shape[1]
    seen = ~np.isnan(lat)
    last = np.maximum.accumulate(np.where(seen, np.arange(n), -1), 1)
    first = np.minimum.accumulate(np.where(seen, np.arange(n), n)[:, ::-1], 1)[:, ::-1]
    edge = np.full((len(lat), 1), -1), np.full((len(lat), 1), n)
    return np.concatenate([edge[0], last], 1), np.concatenate([first, edge[1]], 1)


def _nats(metres: np.ndarray, predicted, sigma, slop_min: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_NATS, -0.5 * (metres - predicted) ** 2 / (sigma**2 + (SLOP_M_PER_MIN * slop_min) ** 2))


def segment_scores(lat: np.ndarray, lon: np.ndarray, cadence: np.ndarray, space: list[State], step_s: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Nats of the net way between the last fix before a segment and the first one after it, for its mode and length: none for a stay, strides for a walk,
    net speed for a vehicle. 0 where a fix is missing, or the mode predicts nothing."""
    before, after = brackets(lat)
    n, days = lat.shape[1], np.arange(len(lat))[:, None]
    cum = np.concatenate([np.zeros((len(lat), 1)), np.cumsum(np.nan_to_num(cadence), 1)], 1)
    modes = [s.mode for s in space]

    def segment(t: int, d: np.ndarray) -> np.ndarray:
        a = t - d
        i, j = before[:, a], after[:, t][:, None]
        ok = (i >= 0) & (j < n)
        x, y = np.where(ok, i, 0), np.where(ok, j, 0)
        metres = np.where(ok, haversine(lat[days, x], lon[days, x], lat[days, y], lon[days, y]), 0.0)
        slop = np.where(ok, (a - i) + (j - t), 0) * step_s / 60
        walked = (cum[:, [t]] - cum[:, a]) * STRIDE_M
        told = {"stationary": (0.0, STILL_M), "walking": (walked, np.maximum(walked * STRIDE_SPREAD, STILL_M))}
        told |= {m: (mean / 3.6 * d * step_s, np.maximum(spread / 3.6 * d * step_s, STILL_M)) for m, (mean, spread) in NET_SPEED.items()}
        each = {m: np.where(ok, _nats(metres, p, s, slop), 0.0) for m, (p, s) in told.items() if m in modes}
        none = np.zeros(metres.shape)
        return np.stack([each.get(m, none) for m in modes], 2)

    return segment


def chain_scores(lat: np.ndarray, lon: np.ndarray, space: list[State], step_s: int, places: dict[int, tuple[float, float]], lines: dict[str, np.ndarray] | None = None) -> Callable[[int], np.ndarray]:
    """[days, from, to] nats of a segment that begins at step t behind one of another state: a stay at a place, or a departure from one, by how far the last fix lies from it; a
    ride on a line by how far its track (lines: legs) lies from the place that was left or, without one, from the last fix."""
    before, _ = brackets(lat)
    days, lines = np.arange(len(lat)), lines or {}
    at = np.array([[places[s.place][0], places[s.place][1]] if s.place in places else [np.nan, np.nan] for s in space])
    stays = np.array([s.mode == "stationary" and s.place in places for s in space])
    moves = np.array([s.mode in MOVING for s in space])
    rides = [i for i, s in enumerate(space) if s.line in lines]

    def off(y: float, x: float, line: str) -> float:
        return min(LINE_MISS_M, float(project(y, x, lines[line])[0].min(initial=LINE_MISS_M)))

    boarding = np.zeros((len(space), len(space)))
    for j in rides:
        for i in np.flatnonzero(stays):
            boarding[i, j] = _nats(np.float64(off(*at[i], space[j].line)), 0.0, LINE_M, np.float64(0.0))

    def pair(t: int) -> np.ndarray:
        i = before[:, t]
        ok = i >= 0
        k = np.where(ok, i, 0)
        slop = (t - i) * step_s / 60
        y, x = lat[days, k], lon[days, k]
        near = np.where(ok[:, None] & stays, _nats(haversine(y[:, None], x[:, None], np.where(stays, at[:, 0], 0.0), np.where(stays, at[:, 1], 0.0)), 0.0, PLACE_M, slop[:, None]), 0.0)
        out = np.tile(boarding, (len(lat), 1, 1)) + near[:, None, :] + near[:, :, None] * moves[None, None, :]
        for j in rides:
            far = np.array([off(y[b], x[b], space[j].line) if ok[b] else 0.0 for b in range(len(lat))])
            out[:, ~stays, j] += np.where(ok, _nats(far, 0.0, LINE_M, slop), 0.0)[:, None]
        return out

    return pair


def place_paths(emission: Callable[[int], np.ndarray], lat: np.ndarray, lon: np.ndarray, cadence: np.ndarray, space: list[State], transition: np.ndarray, duration: np.ndarray, initial: np.ndarray, step_s: int, places: dict[int, tuple[float, float]]) -> np.ndarray:
    """[days, steps]: what semi_viterbi() returns with segment_scores() and chain_scores() without lines. emission(t): [states, days]; the others are [steps, days]. Days lie
    side by side, only maxima are kept, and the path finds lengths and states before it by the same sums. From one place to another there is no way."""
    (n, b), s = lat.shape, len(space)
    if not n or not b:
        return np.zeros((b, n), int)
    most = min(duration.shape[1], n)
    stay = [k for k, x in enumerate(space) if x.mode == "stationary" and x.place in places]
    go = [k for k, x in enumerate(space) if k not in stay and x.mode in MOVING]
    rest = go + [k for k in range(s) if k not in stay and k not in go]
    order = np.array(rest + stay)
    r, m, back = len(rest), len(go), np.argsort(order)
    dur, way = duration[order, :most], transition[np.ix_(order, order)]
    np.fill_diagonal(way, -np.inf)
    # Ways that weigh the same share a sum: rounding keeps order, so the best of the sums is the sum with the best.
    to_stay, to_of = np.unique(way[:r, r:], axis=0, return_inverse=True)
    leave = [(*np.unique(way[r:, x], axis=1, return_inverse=True), x, on) for x, on in ((slice(0, m), True), (slice(m, r), False))] if stay else []
    modes = [space[k].mode for k in rest] + ["stationary"]
    of_mode = [modes[k] for k in range(r)] + ["stationary"] * len(stay)
    mean, spread = (np.array([NET_SPEED.get(x, (0, 0))[i] for x in of_mode]) / 3.6 for i in (0, 1))
    still, walking = (np.array([x == y for x in of_mode]) for y in ("stationary", "walking"))
    silent = ~(still | walking | np.array([x in NET_SPEED for x in of_mode]))
    staying = modes.index("stationary")
    at = np.array([places[space[k].place] for k in stay], float).reshape(-1, 2)

    lat = np.where(np.isnan(lon), np.nan, lat)
    last, first = (x.T for x in brackets(lat.T))
    days, times = np.arange(b), np.arange(n + 1)[:, None]
    has, follows = last >= 0, first < n
    i, j = np.where(has, last, 0), np.where(follows, first, 0)
    y1, x1, y2, x2 = (np.where(on, x[k, days], 0.0) for k, on in ((i, has), (j, follows)) for x in (lat, lon))
    stale, ahead = np.where(has, times - last, np.inf), np.where(follows, first - times, np.inf)  # no fix: so wide that nothing is told
    walks = np.concatenate([np.zeros((1, b)), np.cumsum(np.nan_to_num(cadence), 0)])
    step, day = np.nonzero(~np.isnan(lat))
    step_at, fix = np.searchsorted(step, np.arange(n + 1)), np.zeros((n, b), int)
    fix[step, day] = np.arange(len(step))
    fix = fix[i, days]
    far = -0.5 * haversine(lat[step, day], lon[step, day], at[:, :1], at[:, 1:]) ** 2
    wide = PLACE_M**2 + (SLOP_M_PER_MIN * (stale * step_s / 60)) ** 2

    base, best, full = np.empty((n, s, b)), np.empty((n + 1, s, b)), np.zeros((n + 1, s, b), bool)
    metres, slop = np.zeros((n + 1, most, b)), np.full((n + 1, most, b), np.inf)
    cum, off, seg, den = np.zeros((s, b)), np.zeros((s - r, b)), np.zeros((r + 1, most, b)), np.empty((most, b))
    one, sums, near, out, entry, among = np.empty((s, b)), np.empty((s, b)), np.empty((s - r, b)), np.empty((s - r, b)), np.empty((s, b)), np.empty((r, b))
    base[0] = initial[order][:, None] - cum
    for t in range(1, n + 1):
        most_d = min(most, t)
        told = follows[t] & has[t - 1]
        if tells := told.any():
            a, d = slice(t - 1, t - most_d - 1 if t > most_d else None, -1), np.arange(1, most_d + 1)[:, None]
            metres[t, 0], metres[t, 1:most_d] = metres[t - 1, 0], metres[t - 1, : most_d - 1]
            some = np.flatnonzero(told & ((first[t] != first[t - 1]) | (last[t - 1] != last[t - 2])))  # the others are between the same fixes
            metres[t, :most_d, some] = haversine(y1[a][:, some], x1[a][:, some], y2[t, some], x2[t, some]).T
            slop[t, :most_d] = (SLOP_M_PER_MIN * ((stale[a] + ahead[t]) * step_s / 60)) ** 2
            walked = (walks[t] - walks[a]) * STRIDE_M
            predicted = {"stationary": (0.0, STILL_M), "walking": (walked, np.maximum(walked * STRIDE_SPREAD, STILL_M))}
            predicted |= {x: (x_mean / 3.6 * d * step_s, np.maximum(x_spread / 3.6 * d * step_s, STILL_M)) for x, (x_mean, x_spread) in NET_SPEED.items()}
            for q, mode in enumerate(modes):
                if mode in predicted and (q < r or mode not in modes[:r]):
                    x, y = seg[q, :most_d], den[:most_d]
                    np.subtract(metres[t, :most_d], predicted[mode][0], out=x)
                    x *= x
                    x *= -0.5
                    np.add(predicted[mode][1] ** 2, slop[t, :most_d], out=y)
                    x /= y
                    np.maximum(x, LEAST_NATS, out=x)
        for d in range(1, most_d + 1):
            c = sums if d == 1 else one
            np.add(base[t - d], dur[:, d - 1, None], out=c)
            if tells:
                c[:r] += seg[:r, d - 1]
                c[r:] += seg[staying, d - 1]
            if d == duration.shape[1]:
                full[t] = True if d == 1 else one > sums
            if d > 1:
                np.maximum(sums, one, out=sums)
        e = emission(t - 1)[order]
        np.copyto(e, -1e18, where=np.isneginf(e))
        cum += e
        end = np.add(sums, cum, out=best[t])
        if t < n:
            np.add(way[0, :r, None], end[0], out=entry[:r])
            for k in range(1, r):
                np.maximum(entry[:r], np.add(way[k, :r, None], end[k], out=among), out=entry[:r])
            if s > r:
                some = slice(step_at[t - 1], step_at[t])
                off[:, day[some]] = far[:, some]
                np.maximum(np.divide(off, wide[t], out=near), LEAST_NATS, out=near)
                for w, of, x, on in leave:
                    for k in range(w.shape[1]):
                        np.add(near if on else 0.0, w[:, k, None], out=out)
                        out += end[r:]
                        to = np.flatnonzero(of.ravel() == k) + x.start
                        entry[to] = np.maximum(entry[to], out.max(0))
                entry[r:] = -np.inf
                for k, w in enumerate(to_stay):
                    np.add(near, w[:, None], out=out)
                    out += end[:r][to_of.ravel() == k].max(0)
                    np.maximum(entry[r:], out, out=entry[r:])
            np.maximum(entry, np.where(full[t], end, -np.inf), out=entry)
            np.subtract(entry, cum, out=base[t])

    final = best[n][back]
    state = back[final.argmax(0)]
    top = final.max(0)
    end = np.where(np.isneginf(top) | (top < -1e17), 0, n)  # no segmentation has any probability: the first state
    marks, of = np.zeros((b, n), int), np.zeros((b, n), int)
    of[end == 0] = back[0]
    d = np.arange(1, most + 1)[:, None]
    while (live := np.flatnonzero(end > 0)).size:
        t, k = end[live], state[live]
        a = np.maximum(t - d, 0)
        walked = (walks[t, live] - walks[a, live]) * STRIDE_M
        predicted = np.where(still[k], 0.0, np.where(walking[k], walked, mean[k] * d * step_s))
        sigma = np.where(still[k], STILL_M, np.maximum(np.where(walking[k], walked * STRIDE_SPREAD, spread[k] * d * step_s), STILL_M))
        told = np.where(silent[k], 0.0, np.maximum(LEAST_NATS, -0.5 * (metres[t, d - 1, live] - predicted) ** 2 / (sigma**2 + slop[t, d - 1, live])))
        c = np.where(t >= d, base[a, k, live] + dur.T[:, k] + told, -np.inf)
        a = t - np.minimum(c.argmax(0) + 1, t)
        marks[live, a], of[live, a], end[live] = a, k, a
        live, k, a = (x[a > 0] for x in (live, k, a))
        pair = np.zeros((s, len(live)))
        if s > r:
            near = np.where(has[a, live], np.maximum(far[:, fix[a, live]] / wide[a, live], LEAST_NATS), 0.0) if len(step) else pair[r:].copy()
            pair[:r] = np.where(k >= r, near[np.maximum(k - r, 0), np.arange(len(live))], 0.0)
            pair[r:] = np.where(k < m, near, 0.0)
        x = best[a, :, live].T + (way[:, k] + pair)
        x[k, np.arange(len(live))] = np.where(full[a, k, live], best[a, k, live], -np.inf)
        state[live] = back[x[back].argmax(0)]
    np.maximum.accumulate(marks, 1, out=marks)
    return order[np.take_along_axis(of, marks, 1)]


def _steps(cell: np.ndarray, cells: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many values each cell has, and their sum; NaN: none."""
    ok = ~np.isnan(x)
    count = np.bincount(cell[ok], minlength=cells)
    return count, np.where(count > 0, np.bincount(cell[ok], x[ok], cells), np.nan)


def _medians(cell: np.ndarray, cells: int, x: np.ndarray) -> np.ndarray:
    ok = ~np.isnan(x)
    cell, x = cell[ok], x[ok]
    count = np.bincount(cell, minlength=cells)
    x, begins, out, some = x[np.lexsort((x, cell))], np.cumsum(count) - count, np.full(cells, np.nan), count > 0
    out[some] = 0.5 * x[(begins + (count - 1) // 2)[some]] + 0.5 * x[(begins + count // 2)[some]]
    return out


def _gaussian(x: np.ndarray, mean: float, std: float) -> np.ndarray:
    z = (x - mean) / std
    return -0.5 * z * z - math.log(std) - 0.5 * math.log(2 * math.pi)


def _some(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def locks(lat: np.ndarray, lon: np.ndarray, cadence: np.ndarray, step_s: int) -> np.ndarray:
    """hsmm.class_locks() over [steps, days]: which of hsmm.LOCKS, from 1; 0: nothing."""
    n, b = lat.shape
    days, w = np.arange(b), hsmm.LOCK_STEPS
    last, first = (x.T for x in brackets(np.where(np.isnan(lon), np.nan, lat).T))
    k = np.arange(n)
    low, top = np.maximum(k - w, 0), np.minimum(k + w + 1, n)
    summed = lambda on: np.concatenate([np.zeros((1, b), int), np.cumsum(on, 0)])
    high, told = (x[top] - x[low] for x in (summed(cadence >= hsmm.FOOT_STEPS), summed(~np.isnan(cadence))))

    def between(i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Metres and km/h from steps i to j; NaN where there are none."""
        metres, kmh = np.full((n, b), np.nan), np.full((n, b), np.nan)
        at, of = np.nonzero(ok)
        i, j = i[at, of], j[at, of]
        metres[at, of] = far = haversine(lat[i, of], lon[i, of], lat[j, of], lon[j, of])
        kmh[at, of] = np.where(j > i, far / np.maximum((j - i) * step_s, 1) * 3.6, np.nan)
        return metres, kmh

    spread, about = between(first[low], last[top], (first[low] < top[:, None]) & (last[top] >= low[:, None]))
    _, around = between(last[:n], first[1:], (last[:n] >= 0) & (first[1:] < n))
    kmh = np.where(np.isnan(about), around, about)
    return np.select([high >= hsmm.FOOT_COUNT, (high == 0) & (kmh > hsmm.WALK_KMH), (high == 0) & (told > 0) & (spread < hsmm.STILL_SPREAD_M)], [1, 2, 3], 0)


def day_emissions(lat: np.ndarray, lon: np.ndarray, speed: np.ndarray, hr: np.ndarray, cadence: np.ndarray, entry: np.ndarray, bed: np.ndarray, space: list[State], step_s: int, places: dict[int, tuple[float, float]]) -> Callable[[int], np.ndarray]:
    """For a step, [states, days]: hsmm.state_emissions() with class locks. Arrays are [steps, days]; entry: [places, days] nats; bed: the steps that are in bed."""
    n, b = lat.shape
    modes = {}
    for mode in dict.fromkeys(x.mode for x in space):
        p0 = hsmm.NO_STEPS[mode]
        feet = np.where(cadence == 0, math.log(p0), math.log(1 - p0) + _gaussian(cadence, *hsmm.STEPS[mode]))
        e = math.log(hsmm.PRIOR[mode]) + _some(_gaussian(speed, *hsmm.SPEED[mode])) + _some(_gaussian(hr, *hsmm.HEART[mode])) + _some(feet)
        modes[mode] = e + np.where(bed, math.log(hsmm.IN_BED[mode]), math.log(1 - hsmm.IN_BED[mode]))[:, None]
    step, day = np.nonzero(~(np.isnan(lat) | np.isnan(lon)))
    lock, of, far = locks(lat, lon, cadence, step_s), list(places), modes["stationary"] - 3.0  # as hsmm.place_emission() has it for a step without a fix
    bars = {mode: np.isin(range(len(hsmm.LOCKS) + 1), [i for i, on in enumerate(hsmm.LOCKS.values(), 1) if mode not in on])[lock] for mode in modes}
    step_at = np.searchsorted(step, np.arange(n + 1))
    lat, lon = lat[step, day], lon[step, day]
    near = {x.place: modes["stationary"][step, day] + np.maximum(-3.0, -0.5 * (haversine(lat, lon, *places[x.place]) / 150) ** 2) for x in space if x.place is not None}
    nowhere = modes["stationary"] - 2.0

    def emission(t: int) -> np.ndarray:
        out, some = np.empty((len(space), b)), slice(step_at[t], step_at[t + 1])
        for k, x in enumerate(space):
            if x.place is not None:
                out[k] = far[t]
                out[k, day[some]] = near[x.place][some]
                if t == 0:
                    out[k] += _some(entry[of.index(x.place)])
            else:
                out[k] = nowhere[t] if x.mode == "stationary" else modes[x.mode][t]
            np.copyto(out[k], -np.inf, where=bars[x.mode][t])
        return out

    return emission


#: Days that a block of the recursion takes at most: enough for the cost of calls not to count.
BLOCK = 1024


def decode_fixes(fixes: DataFrame, keys: list[str], places: dict[int, tuple[float, float]], entry: str, bed_s: tuple[int, int], step_s: int = 60, day_s: int = 86_400, t: str = "t", dealt: bool = False) -> DataFrame:
    """What hsmm.decode() tells with place_at of hsmm.observations() with class locks, distances to the places, `entry` (a column of a day, the same in all its fixes: nats of
    entering each place) and in bed from bed_s[0] to before bed_s[1] seconds of a day. dealt: a key's rows lie in one task.

    A task gets fixes alone: steps are made, weighed and decoded there, many days side by side, so that nothing of a step goes through Spark."""
    day = list(dict.fromkeys([*keys, "day_start"]))
    numbers = ["lat", "lon", "speed_kmh", "bpm", "steps"]
    rows = fixes.select(*day, F.col(t).cast("long").alias("__t"), *(F.col(c).cast("double").alias(c) for c in numbers), F.col(entry).cast("array<double>").alias("__entry")).where("__t is not null and day_start is not null")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = (rows if dealt else groups.dealt(rows, keys)).sortWithinPartitions(*day, "__t")
    space = hsmm.states(list(places), [])
    way, long, begin = hsmm.transitions(space), hsmm.durations(space, step_s=step_s), np.full(len(space), -math.log(len(space)))
    n = -(-day_s // step_s)
    bed = (np.arange(n) * step_s >= bed_s[0]) & (np.arange(n) * step_s < bed_s[1])
    some = max(1, min(BLOCK, 4 * hsmm.CELLS // (n * min(n, long.shape[1]) * 8)))
    modes, spots = pa.array([x.mode for x in space]), pa.array([x.place for x in space], pa.int64())

    def work(table: pa.Table, begins: np.ndarray) -> pa.Table:
        b = len(begins) - 1
        lengths = np.diff(begins)
        start = table.column("day_start").to_numpy().astype(np.int64)[begins[:-1]]
        of = np.repeat(np.arange(b), lengths)
        at = table.column("__t").to_numpy().astype(np.int64) // step_s * step_s - start[of]
        ok = (at >= 0) & (at < day_s) & (at % step_s == 0)
        cell = (at // step_s * b + of)[ok]
        column = {c: table.column(c).to_numpy(zero_copy_only=False)[ok].astype(float) for c in numbers}
        grid = lambda x: x.reshape(n, b)
        lat, lon = (grid(_medians(cell, n * b, column[c])) for c in ("lat", "lon"))
        with np.errstate(invalid="ignore", divide="ignore"):
            speed, hr = (grid(np.divide(*_steps(cell, n * b, column[c])[::-1])) for c in ("speed_kmh", "bpm"))
        cadence = grid(_steps(cell, n * b, column["steps"])[1])
        enter = table.column("__entry").take(pa.array(begins[:-1])).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b, len(places)).T
        emission = day_emissions(lat, lon, speed, hr, cadence, enter, bed, space, step_s, places)
        path = place_paths(emission, lat, lon, cadence, space, way, long, begin, step_s, places)
        new = np.ones((b, n + 1), bool)
        new[:, 1:n] = path[:, 1:] != path[:, :-1]
        k, i = np.nonzero(new[:, :n])
        j = np.nonzero(new[:, 1:])[1] + 1
        state = pa.array(path[k, i])
        told = [table.column(c).take(pa.array(begins[k])) for c in keys]
        return pa.table([*told, pa.array(start[k] + i * step_s), pa.array(start[k] + j * step_s), modes.take(state), spots.take(state)], names=[*keys, "start_ts", "end_ts", "mode", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups.whole(batches, day):
            for k in range(0, len(bounds) - 1, some):
                part = bounds[k : k + some + 1]
                yield from work(table.slice(int(part[0]), int(part[-1] - part[0])), part - part[0]).to_batches()

    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start_ts long, end_ts long, mode string, place long")
