"""Trajectory kernels: recursions that depend on their own output, run per user (and day) on sorted rows in pandas groups.

Each kernel is a plain function over numpy arrays, and a DataFrame operator that applies it to groups. Groups are a user's day or a
user's history, not all of a table's rows.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from daygrain.operators import groups

R_M = 6_371_000.0
M_PER_DEGREE = 111_320.0

# Quality filter
WORST_ACCURACY_M, TELEPORT_KMH, COARSE_M, COARSE_KMH = 800.0, 150.0, 80.0, 15.0
BRIDGE_S, BRIDGE_FAR_M = 1800, 800.0
# Kalman filter
ACCURACY_M, RESET_S, JUMP_KMH, GATE = 20.0, 3600, 200.0, 50.0
# Windows, stays and places
WINDOW_S, STAY_M, STAY_S, CLUSTER_M = 300, 100.0, 600, 150.0


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * R_M * np.arcsin(np.sqrt(np.minimum(1.0, a)))


def flat(lat1, lon1, lat2, lon2):
    dx = (lon2 - lon1) * M_PER_DEGREE * np.cos(np.radians((lat1 + lat2) / 2))
    return np.hypot(dx, (lat2 - lat1) * M_PER_DEGREE)


def _flat(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """flat() of two points."""
    return math.hypot((lon2 - lon1) * M_PER_DEGREE * math.cos(math.radians((lat1 + lat2) / 2)), (lat2 - lat1) * M_PER_DEGREE)


def bearing(lat1, lon1, lat2, lon2):
    p1, p2, d = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    return np.degrees(np.arctan2(np.sin(d) * np.cos(p2), np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(d))) % 360


def quality(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, acc: np.ndarray) -> np.ndarray:
    """Which fixes are kept. acc: metres, NaN where unknown; rows are sorted by time."""
    index = np.flatnonzero(~(acc > WORST_ACCURACY_M))
    if len(index) <= 2:
        return index
    t, lat, lon, acc = (x[index].tolist() for x in (t, lat, lon, acc))

    def kmh(i: int, j: int) -> float:
        d = _flat(lat[i], lon[i], lat[j], lon[j])
        return float("inf") if t[j] <= t[i] and d > 0 else 0.0 if t[j] <= t[i] else d / (t[j] - t[i]) * 3.6

    def garbage(anchor: int, i: int) -> bool:
        v = kmh(anchor, i)
        return v > TELEPORT_KMH or (acc[i] > COARSE_M and v > COARSE_KMH)

    kept, i = [0], 1
    while i < len(t):
        anchor = kept[-1]
        if not garbage(anchor, i):
            kept.append(i)
            i += 1
            continue
        bridge = -1
        for j in range(i + 1, len(t)):
            if t[j] - t[i] > BRIDGE_S:
                break
            if not garbage(anchor, j) and not acc[j] > COARSE_M and (j + 1 >= len(t) or kmh(j, j + 1) <= TELEPORT_KMH):
                bridge = j
                break
        teleport = kmh(anchor, i) > TELEPORT_KMH
        if bridge >= 0 and (teleport or _flat(lat[anchor], lon[anchor], lat[bridge], lon[bridge]) > BRIDGE_FAR_M):
            kept.append(bridge)
            i = bridge + 1
        else:
            kept.append(i)
            i += 1
    return index[kept]


#: Columns of a filtered track.
TRACK = ["t", "lat", "lon", "speed_kmh", "bearing"]


def kalman(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, acc: np.ndarray) -> pd.DataFrame:
    """The filtered track: t, lat, lon, speed_kmh (one decimal), bearing (whole degrees)."""
    return pd.DataFrame(kalman_rows(t, lat, lon, acc), columns=TRACK)


def kalman_rows(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, acc: np.ndarray) -> list[tuple]:
    """The rows of kalman(). Two filters of constant velocity, a degree axis each.

    Fixes with no time since the last are skipped. A gap, a jump or three refused fixes in a row begin anew; a fix far outside what was
    expected is refused and gives no row."""
    out: list[tuple] = []
    if not len(t):
        return out
    times, z = t.tolist(), list(zip(lat.tolist(), lon.tolist(), strict=True))
    metres = np.where(np.isnan(acc), ACCURACY_M, np.maximum(acc, 1.0)).tolist()
    k_deg = (M_PER_DEGREE, M_PER_DEGREE * max(0.01, math.cos(math.radians(z[0][0]))))
    axes = (0, 1)
    where, pace = [0.0, 0.0], [0.0, 0.0]  # by axis: the state, and the covariance's three numbers
    c00, c01, c11 = [0.0, 0.0], [0.0, 0.0], [0.0, 0.0]
    last, bound, refused = -1, 0.0, 0

    def begin(i: int, wide: float) -> None:
        ahead = wide > 1 and i + 1 < len(times) and 0 < times[i + 1] - times[i] < 600
        for a in axes:
            where[a] = z[i][a]
            pace[a] = (z[i + 1][a] - z[i][a]) / (times[i + 1] - times[i]) if ahead else 0.0
            c00[a], c01[a], c11[a] = (metres[i] / k_deg[a]) ** 2, 0.0, (1.0 / k_deg[a]) ** 2 * wide

    for i, now in enumerate(times):
        if last < 0:
            begin(i, 1.0)
            out.append((now, *z[i], 0.0, 0))
            last = i
            continue
        dt = now - times[last]
        if dt <= 0:
            continue
        d = _flat(*z[last], *z[i])
        kmh = d / dt * 3.6
        if dt > RESET_S or (dt > 300 and kmh > JUMP_KMH) or (dt >= 600 and d >= 500) or refused >= 3:
            begin(i, 100.0)
        else:
            speed = math.hypot(pace[0] * k_deg[0], pace[1] * k_deg[1]) * 3.6
            noise = 0.1 if speed > 80 else 0.5 if speed > 30 else 1.0 if speed > 7 else 2.0
            told, far = [], 0.0
            for a in axes:
                q = (noise / k_deg[a]) ** 2
                p01 = c01[a] + dt * c11[a] + q * dt**2 / 2
                p00 = c00[a] + 2 * dt * c01[a] + dt * dt * c11[a] + q * dt**3 / 3
                off = z[i][a] - (where[a] + pace[a] * dt)
                s = p00 + (metres[i] / k_deg[a]) ** 2
                far += off * off / s
                told.append((off, p00, p01, c11[a] + q * dt, p00 / s, p01 / s))
            if far > GATE:
                refused += 1
                continue
            for a, (off, p00, p01, p11, g0, g1) in zip(axes, told, strict=True):
                where[a] += pace[a] * dt + g0 * off
                pace[a] += g1 * off
                c00[a], c01[a], c11[a] = p00 - g0 * p00, p01 - g0 * p01, p11 - g1 * p01
        refused = 0
        if z[i] != z[last]:
            bound = max(2 * kmh, 5.0)
        vy, vx = pace[0] * k_deg[0] * 3.6, pace[1] * k_deg[1] * 3.6
        speed = math.hypot(vy, vx)
        if speed > max(bound, 5.0):
            for a in axes:
                pace[a] *= max(bound, 5.0) / speed
            speed = max(bound, 5.0)
        head = round(math.degrees(math.atan2(vx, vy)) % 360) % 360 if speed > 0 else 0
        out.append((now, *where, round(speed, 1), head))
        last = i
    return out


def windows(t: np.ndarray, span_s: int = WINDOW_S) -> np.ndarray:
    """A window's number for each fix: windows begin at the first fix that the one before doesn't hold."""
    out, start, k = np.zeros(len(t), int), None, -1
    for i, x in enumerate(t):
        if start is None or x - start >= span_s:
            start, k = x, k + 1
        out[i] = k
    return out


def mine_stays(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius_m: float = STAY_M, least_s: int = STAY_S) -> list[tuple[int, int]]:
    """Ranges [i, j) of fixes that keep within `radius_m` of their upper median, for `least_s` or longer; extended greedily.

    The fixes so far stay sorted, and only where their box doesn't tell are all distances taken."""
    out, i, ys, xs = [], 0, lat.tolist(), lon.tolist()
    while i < len(t):
        j, sorted_y, sorted_x = i + 1, [ys[i]], [xs[i]]
        while j < len(t):
            insort(sorted_y, ys[j])
            insort(sorted_x, xs[j])
            y, x = sorted_y[(j + 1 - i) // 2], sorted_x[(j + 1 - i) // 2]
            north, east = max(sorted_y[-1] - y, y - sorted_y[0]), max(sorted_x[-1] - x, x - sorted_x[0])
            if north * M_PER_DEGREE > 1.01 * radius_m:
                break
            if math.hypot(north, east * math.cos(math.radians(min(abs(sorted_y[0]), abs(sorted_y[-1]))))) * M_PER_DEGREE > 0.98 * radius_m and haversine(y, x, lat[i : j + 1], lon[i : j + 1]).max() > radius_m:
                break
            j += 1
        if j - i >= 2 and t[j - 1] - t[i] >= least_s:
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def running_stays(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, radius_m: float, least_s: int) -> list[tuple[int, int]]:
    """Ranges of fixes that keep within `radius_m` of the mean of those before them in the range, two or more over `least_s`."""
    out, i = [], 0
    while i < len(t):
        j, y, x = i + 1, lat[i], lon[i]
        while j < len(t) and haversine(y, x, lat[j], lon[j]) <= radius_m:
            n = j - i
            y, x, j = (y * n + lat[j]) / (n + 1), (x * n + lon[j]) / (n + 1), j + 1
        if j - i >= 2 and t[j - 1] - t[i] >= least_s:
            out.append((i, j))
        i = j
    return out


def cluster(lat: np.ndarray, lon: np.ndarray, dwell: np.ndarray, radius_m: float = CLUSTER_M) -> np.ndarray:
    """A cluster's number for each stay: first fit to the nearest within the radius, centres weighted by dwell; then clusters whose centres lie
    within the radius are put together until none do."""
    of, ys, xs, ws = np.zeros(len(lat), int), [], [], []
    for i in range(len(lat)):
        d = haversine(np.asarray(ys), np.asarray(xs), lat[i], lon[i]) if ys else np.zeros(0)
        k = int(d.argmin()) if len(d) and d.min() <= radius_m else len(ys)
        if k == len(ys):
            ys.append(lat[i]); xs.append(lon[i]); ws.append(max(float(dwell[i]), 1.0))  # noqa: E702
        else:
            w = max(float(dwell[i]), 1.0)
            ys[k], xs[k], ws[k] = (ys[k] * ws[k] + lat[i] * w) / (ws[k] + w), (xs[k] * ws[k] + lon[i] * w) / (ws[k] + w), ws[k] + w
        of[i] = k
    y, x, w = (np.asarray(v, float) for v in (ys, xs, ws))
    d = haversine(y[:, None], x[:, None], y[None], x[None]) if len(y) else np.zeros((0, 0))
    d[np.tril_indices(len(y))] = np.inf
    into = np.arange(len(y))
    while len(y) > 1:
        a, b = np.unravel_index(d.argmin(), d.shape)
        if d[a, b] > radius_m:
            break
        both = w[a] + w[b]
        y[a], x[a], w[a] = (y[a] * w[a] + y[b] * w[b]) / both, (x[a] * w[a] + x[b] * w[b]) / both, both
        d[b], d[:, b] = np.inf, np.inf  # it is part of the other now
        into[into == b] = a
        new = haversine(y, x, y[a], x[a])
        left = np.isin(np.arange(len(y)), into)
        d[a, a + 1 :] = np.where(left[a + 1 :], new[a + 1 :], np.inf)
        d[:a, a] = np.where(left[:a], new[:a], np.inf)
    return np.unique(into, return_inverse=True)[1][of] if len(y) else of


def circle_kmeans(hours: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Two groups of times of day on the circle of 24 hours; the group of the earlier centre is 0."""
    p = np.stack([np.cos(hours / 12 * np.pi), np.sin(hours / 12 * np.pi)], 1)
    if len(p) < 2:
        return np.zeros(len(p), int)
    far = ((p - p[0]) ** 2).sum(1).argmax()
    c, of = np.stack([p[0], p[far]]), None
    for _ in range(rounds):
        new = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if of is not None and (new == of).all():
            break
        of = new
        c = np.stack([p[of == k].mean(0) if (of == k).any() else c[k] for k in (0, 1)])
    at = np.arctan2(c[:, 1], c[:, 0]) % (2 * np.pi)
    return of if at[0] <= at[1] else 1 - of


def split_cluster(hours: np.ndarray, day: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """0 or 1 a stay: a cluster used at two times of day and at two spots is two places. All 0 unless there are four days, an empty band of one and
    a half hours on both sides, two days a side and 30 m between the centres."""
    none = np.zeros(len(hours), int)
    if len(np.unique(day)) < 4:
        return none
    of = circle_kmeans(hours)
    if of.min() == of.max() or any(len(np.unique(day[of == k])) < 2 for k in (0, 1)):
        return none
    order = np.argsort(hours, kind="stable")
    h, side = np.append(hours[order], hours[order[0]] + 24), np.append(of[order], of[order[0]])
    gap = np.diff(h)[side[1:] != side[:-1]].min()  # the nearest two of both sides are neighbours on the circle
    centre = [(lat[of == k].mean(), lon[of == k].mean()) for k in (0, 1)]
    return of if gap >= 1.5 and haversine(*centre[0], *centre[1]) >= 30 else none


def core_displacement(t: np.ndarray, lat: np.ndarray, lon: np.ndarray, vehicle_kmh: float = 15.0, kmh: np.ndarray | None = None) -> float:
    """The largest net displacement of a run of fixes without a step at a vehicle's pace. kmh: from each fix to the next, where known."""
    if len(t) < 2:
        return 0.0
    v = haversine(lat[:-1], lon[:-1], lat[1:], lon[1:]) / np.maximum(np.diff(t), 1) * 3.6 if kmh is None else kmh
    cut = np.flatnonzero(v > vehicle_kmh) + 1
    a, b = np.append(0, cut), np.append(cut, len(t)) - 1
    return float(haversine(lat[a], lon[a], lat[b], lon[b]).max())


def incoherent_stay(length_s: float, linearity: float, displacement_m: float, kmh: float) -> bool:
    """Whether a 'stay' is a walk: straight and far; a stay of 45 minutes or longer below half a km/h remains one."""
    return linearity > 0.7 and displacement_m > 90 and not (length_s >= 2700 and kmh < 0.5)


def greedy_match(pairs: pd.DataFrame) -> pd.DataFrame:
    """One-to-one pairs of old_id and new_id, nearest first (distance_m), then the smaller old_id."""
    used_old, used_new, kept = set(), set(), []
    for r in pairs.sort_values(["distance_m", "old_id", "new_id"]).itertuples():
        if r.old_id not in used_old and r.new_id not in used_new:
            used_old.add(r.old_id)
            used_new.add(r.new_id)
            kept.append(r.Index)
    return pairs.loc[kept]


def by_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies a kernel to each group, sorted; `work` gets no empty group and returns the columns of `schema` besides the keys."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable").reset_index(drop=True)
        out = work(g)
        for i, k in enumerate(keys):
            out.insert(i, k, g[k].iloc[0])
        return out

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return groups.dealt(df, keys).groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def smoothed(fixes: DataFrame, keys: list[str], tie: str = "event_id", span_s: int = WINDOW_S) -> DataFrame:
    """The quality filter, the Kalman filter and the windows in one kernel, so that fixes (t, lat, lon, accuracy) are shuffled once, many keys a batch: t, lat, lon,
    speed_kmh, bearing, win."""

    kinds = {f.name: f.dataType.simpleString() for f in fixes.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups.whole(batches, keys):
            of = [table.column(c).to_numpy(zero_copy_only=False) for c in ("t", "lat", "lon", "accuracy")]
            t, lat, lon, acc = of[0].astype(np.int64), *(x.astype(float) for x in of[1:])
            rows, win, at = [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                keep = lo + quality(t[lo:hi], lat[lo:hi], lon[lo:hi], acc[lo:hi])
                some = kalman_rows(t[keep], lat[keep], lon[keep], acc[keep])
                rows += some
                win += windows([r[0] for r in some], span_s).tolist()
                at += [lo] * len(some)
            if rows:
                told = (pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()), strict=True))
                yield from pa.table([*(table.column(k).take(pa.array(at)) for k in keys), *told, pa.array(win, pa.int64())], names=[*keys, *TRACK, "win"]).to_batches()

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", t long, lat double, lon double, speed_kmh double, bearing int, win long"
    rows = fixes.select(*keys, "t", tie, "lat", "lon", "accuracy")
    return groups.dealt(rows, keys).sortWithinPartitions(*keys, "t", tie).mapInArrow(work, schema)


def filter_quality(fixes: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """Fixes (t, lat, lon, accuracy) without those that the quality filter drops."""
    rest = [c for c in fixes.columns if c not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in fixes.schema}

    def work(g: pd.DataFrame) -> pd.DataFrame:
        keep = quality(g.t.to_numpy(float), g.lat.to_numpy(float), g.lon.to_numpy(float), g.accuracy.to_numpy(float))
        return g.loc[keep, rest].reset_index(drop=True)

    return by_group(fixes, keys, ["t", tie], work, ", ".join(f"{c} {kinds[c]}" for c in rest))


def filter_kalman(fixes: DataFrame, keys: list[str], tie: str = "event_id") -> DataFrame:
    """t, lat, lon, speed_kmh, bearing of the filtered track."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        return kalman(g.t.to_numpy(np.int64), g.lat.to_numpy(float), g.lon.to_numpy(float), g.accuracy.to_numpy(float))

    return by_group(fixes, keys, ["t", tie], work, "t long, lat double, lon double, speed_kmh double, bearing int")


def number_windows(track: DataFrame, keys: list[str], tie: str = "t", span_s: int = WINDOW_S) -> DataFrame:
    """The track with `win`, the number of each fix's window."""
    rest = [c for c in track.columns if c not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in track.schema}

    def work(g: pd.DataFrame) -> pd.DataFrame:
        return g[rest].assign(win=windows(g.t.to_numpy(), span_s))

    return by_group(track, keys, ["t", tie], work, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", win long")


def stays(fixes: DataFrame, keys: list[str], tie: str = "event_id", kernel: Callable = mine_stays, **settings) -> DataFrame:
    """Mined stays: start_ts, end_ts, lat, lon (means), n."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        t, lat, lon = g.t.to_numpy(), g.lat.to_numpy(float), g.lon.to_numpy(float)
        rows = [(t[i], t[j - 1], lat[i:j].mean(), lon[i:j].mean(), j - i) for i, j in kernel(t, lat, lon, **settings)]
        return pd.DataFrame(rows, columns=["start_ts", "end_ts", "lat", "lon", "n"])

    return by_group(fixes, keys, ["t", tie], work, "start_ts long, end_ts long, lat double, lon double, n long")


def clusters(stays_: DataFrame, keys: list[str], split: bool = True) -> DataFrame:
    """Stays with `cluster`, numbered by falling dwell; clusters are split by time of day if `split`. stays: start_ts, end_ts, lat, lon."""
    rest = [c for c in stays_.columns if c not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in stays_.schema}

    def work(g: pd.DataFrame) -> pd.DataFrame:
        lat, lon, dwell = g.lat.to_numpy(float), g.lon.to_numpy(float), (g.end_ts - g.start_ts).to_numpy(float)
        of = cluster(lat, lon, dwell)
        if split:
            local = (g.start_ts + g.end_ts).to_numpy(float) / 2 + lon / 15 * 3600
            for k in range(of.max() + 1):
                on = np.flatnonzero(of == k)
                side = split_cluster(local[on] % 86_400 / 3600, local[on] // 86_400, lat[on], lon[on])
                if side.any():
                    of[on[side == 1]] = of.max() + 1
        total = pd.Series(dwell).groupby(of).sum().sort_values(ascending=False, kind="stable")
        return g[rest].assign(cluster=pd.Series(range(len(total)), index=total.index).loc[of].to_numpy())

    return by_group(stays_, keys, ["start_ts", "end_ts"], work, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", cluster long")


def match_identity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy one-to-one matches of old and new clusters."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        return greedy_match(g)[["old_id", "new_id", "distance_m"]].reset_index(drop=True)

    return by_group(pairs, keys, ["distance_m", "old_id", "new_id"], work, "old_id long, new_id long, distance_m double")
