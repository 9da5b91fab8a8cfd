"""The hidden semi-Markov decoder of a day: observations, states, transitions, emissions, durations, decoding.

Observations and emissions are DataFrame expressions; decoding is a numpy recursion over many days of equal length at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import chance, geo
from daygrain.operators import groups, series

#: Fixed values. Per mode: prior; speed, heart rate and steps as mean and deviation, with the probability of no steps; the chance of being in bed;
#: shape and rate of the duration in minutes.
MODES = ("stationary", "walking", "cycling", "driving", "train", "plane", "unknown")
PRIOR = dict(zip(MODES, (0.7, 0.1, 0.01, 0.02, 0.05, 0.005, 0.1), strict=True))
SPEED = dict(zip(MODES, ((0, 2), (5, 2), (18, 6), (40, 20), (50, 30), (600, 200), (20, 200)), strict=True))
HEART = dict(zip(MODES, ((70, 15), (100, 20), (130, 20), (75, 15), (75, 15), (70, 15), (80, 100)), strict=True))
NO_STEPS = dict(zip(MODES, (0.99, 0.05, 0.95, 0.99, 0.99, 0.99, 0.5), strict=True))
STEPS = dict(zip(MODES, ((10, 20), (100, 25), (30, 30), (5, 10), (5, 10), (5, 10), (50, 100)), strict=True))
IN_BED = dict(zip(MODES, (0.99, 0.0001, 0.0001, 0.0001, 0.1, 0.3, 0.05), strict=True))
DURATION = dict(zip(MODES, ((0.85, 0.0043), (1.07, 0.034), (1.0, 0.05), (0.42, 0.008), (1.74, 0.053), (1.0, 0.011), (0.45, 0.0034)), strict=True))
LEAST_MINUTES = {"plane": 30, "unknown": 1}
SELF = 0.95
MOST_MINUTES = 240
VEHICLES = ("cycling", "driving", "train", "plane")


def observations(fixes: DataFrame, keys: list[str], step_s: int = 60, day_s: int = 86_400, t: str = "t", by: list[str] | None = None, first: tuple[str, ...] = ()) -> DataFrame:
    """A row for each step of each day with a fix: medians of lat and lon, means of speed_kmh and bpm (hr), sums of steps (cadence); null where there is
    none. fixes: day_start, t, lat, lon, speed_kmh, bpm, steps. first: columns of a day, the same in all its fixes, that its first step gets.

    Fixes are dealt once, by keys or by those of `by`; a day becomes its steps in its own task, so that what groups by keys shuffles no steps."""
    day = list(dict.fromkeys([*keys, "day_start"]))
    rows = groups.dealt(fixes.select(*day, *first, F.col(t).alias("__t"), "lat", "lon", "speed_kmh", "bpm", "steps"), by or keys)
    a = rows.groupBy(*day, (F.floor(F.col("__t") / step_s) * step_s).alias("__t")).agg(
        F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.avg("speed_kmh").alias("speed_kmh"), F.avg("bpm").alias("hr"), F.sum("steps").alias("cadence"), *(F.first(c).alias(c) for c in first)
    )
    names = ["lat", "lon", "speed_kmh", "hr", "cadence"]
    kinds = {f.name: f.dataType for f in a.schema}
    days = a.groupBy(*day).agg(F.collect_list(F.struct(F.col("__t").alias("t"), *names)).alias("__seen"), *(F.first(c).alias(c) for c in first))
    grid = F.sequence(F.col("day_start").cast("long"), (F.col("day_start") + day_s - 1).cast("long"), F.lit(step_s).cast("long"))
    seen = F.filter("__seen", lambda x: (x["t"] >= F.col("day_start")) & (x["t"] < F.col("day_start") + day_s) & (F.pmod(x["t"] - F.col("day_start"), F.lit(step_s)) == 0))
    none = F.transform(F.array_except("__grid", F.transform("__seen", lambda x: x["t"])), lambda x: F.struct(x.alias("t"), *(F.lit(None).cast(kinds[c]).alias(c) for c in names)))
    days = days.withColumn("__grid", grid).withColumn("__seen", seen)
    out = days.select(*day, *first, F.explode(F.concat("__seen", none)).alias("__s")).select(*day, F.col("__s.t").alias("t"), *(F.col(f"__s.{c}").alias(c) for c in names), *first)
    return out.withColumns({c: F.when(F.col("t") == F.col("day_start"), F.col(c)) for c in first})


def steps_seen(fixes: DataFrame, keys: list[str], step_s: int = 60, day_s: int = 86_400, t: str = "t") -> DataFrame:
    """keys, lat, lon of the steps of observations() that have a fix."""
    day = list(dict.fromkeys([*keys, "day_start"]))
    at = F.floor(F.col(t) / step_s) * step_s
    inside = (at >= F.col("day_start")) & (at < F.col("day_start") + day_s) & (F.pmod(at - F.col("day_start"), F.lit(step_s)) == 0)
    rows = groups.dealt(fixes.where(inside).select(*day, at.alias("__t"), "lat", "lon"), keys)
    return rows.groupBy(*day, "__t").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon")).select(*keys, "lat", "lon")


def mode_emission(mode: str, speed: Column, hr: Column, cadence: Column) -> Column:
    """Nats of a mode's prior and of what was seen; a null says nothing."""
    some = lambda x: F.coalesce(x, F.lit(0.0))
    return (
        F.lit(math.log(PRIOR[mode])) + some(chance.gaussian(speed, *SPEED[mode])) + some(chance.gaussian(hr, *HEART[mode])) + some(chance.zero_inflated(cadence, NO_STEPS[mode], *STEPS[mode]))
    )


def bed_emission(mode: str, in_bed: Column) -> Column:
    return F.coalesce(chance.bernoulli(in_bed, IN_BED[mode]), F.lit(0.0))


def place_emission(distance_m: Column) -> Column:
    return F.greatest(F.lit(-3.0), -0.5 * F.pow(distance_m / 150, 2))


def feasibility(implied_kmh: Column) -> Column:
    """Nats for a place that the fixes before and after can't be reached from in time."""
    return F.when(implied_kmh > 80, -0.5 * F.pow((implied_kmh - 80) / 20, 2)).otherwise(0.0)


@dataclass(frozen=True)
class State:
    mode: str
    place: int | None = None
    line: str | None = None

    @property
    def key(self) -> str:
        return f"{self.mode}|{'' if self.place is None else self.place}|{self.line or ''}"


def states(places: list[int], lines: list[str]) -> list[State]:
    """Moving modes, a stay nowhere, one at each place, a train on each line and on an unknown one."""
    return [*(State(m) for m in ("walking", "cycling", "driving", "plane", "unknown")), State("stationary"), *(State("stationary", p) for p in places), *(State("train", line=x) for x in lines), State("train")]


def transitions(space: list[State], near: set[tuple[str, int]] | None = None) -> np.ndarray:
    """Log-probabilities: 0.95 of staying, the rest by weight. From one place to another there is no way but a move, and a line that doesn't come near a
    place (near: pairs of line and place; None: all do) neither begins nor ends there; between vehicles it is rare."""
    n = len(space)
    w = np.ones((n, n))
    for i, a in enumerate(space):
        for j, b in enumerate(space):
            if i == j:
                w[i, j] = 0
            elif a.mode == b.mode == "stationary" and a.place is not None and b.place is not None:
                w[i, j] = 0
            elif a.mode in VEHICLES and b.mode in VEHICLES:
                w[i, j] = math.exp(-8)
            for x, y in ((a, b), (b, a)):
                if near is not None and x.mode == "train" and x.line and y.place is not None and (x.line, y.place) not in near:
                    w[i, j] = 0
    total = w.sum(1, keepdims=True)
    p = np.where(total > 0, (1 - SELF) * w / np.where(total > 0, total, 1), 0)
    np.fill_diagonal(p, SELF)
    with np.errstate(divide="ignore"):
        return np.log(p)


def log_duration(mode: str, minutes: np.ndarray) -> np.ndarray:
    shape, rate = DURATION[mode]
    out = shape * math.log(rate) + (shape - 1) * np.log(minutes) - rate * minutes - math.lgamma(shape)
    return np.where(minutes < LEAST_MINUTES.get(mode, 2), -10.0, out)


def durations(space: list[State], most: int = MOST_MINUTES, step_s: int = 60) -> np.ndarray:
    """[state, d - 1]: the log-probability of d steps, up to `most` minutes: the density of their minutes by a step's width."""
    minutes = step_s / 60
    return np.stack([log_duration(s.mode, minutes * np.arange(1, max(1, int(most / minutes)) + 1)) for s in space]) + math.log(minutes)


def viterbi(emission: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """The best path of a plain Markov model; ties keep the first state, and so does a path without any probability."""
    n, s = emission.shape
    if not n:
        return np.zeros(0, int)
    best, back = initial + emission[0], np.zeros((n, s), int)
    for t in range(1, n):
        c = best[:, None] + transition
        back[t] = c.argmax(0)
        best = c.max(0) + emission[t]
    path = np.zeros(n, int)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


#: segment(t, d): nats of the segments that end before step t and have the lengths d, as [days or 1, lengths, states].
Segments = Callable[[int, np.ndarray], np.ndarray]
#: pair(t): nats of a segment of one state that begins at step t behind one of another, as [days or 1, from, to].
Pairs = Callable[[int], np.ndarray]


def semi_viterbi(emission: np.ndarray, transition: np.ndarray, duration: np.ndarray, initial: np.ndarray, segment: Segments | None = None, pair: Pairs | None = None) -> np.ndarray:
    """The best segmentation of each day of [days, steps, states], or of one day of [steps, states]: each segment of state s and length d
    adds its emissions, its duration, what `segment` tells of it as a whole, and the way in from another state with what `pair` tells of both.

    Longer stays than the table tells are chained from the same state without a cost of entry. Ties keep the first."""
    if emission.ndim == 2:
        return semi_viterbi(emission[None], transition, duration, initial, segment, pair)[0]
    b, n, s = emission.shape
    most = min(duration.shape[1], n)
    path = np.zeros((b, n), int)
    if not n or not b:
        return path
    way, diagonal = transition.copy(), np.arange(s)
    np.fill_diagonal(way, -np.inf)
    cum = np.zeros((b, n + 1, s))
    np.cumsum(np.where(np.isneginf(emission), -1e18, emission), 1, out=cum[:, 1:])
    best = np.full((b, n + 1, s), -np.inf)  # of segmentations that end before t, in s
    entry = np.full((b, n + 1, s), -np.inf)
    entry[:, 0] = initial
    came, length = np.zeros((b, n + 1, s), int), np.zeros((b, n + 1, s), int)
    for t in range(1, n + 1):
        d = np.arange(1, min(most, t) + 1)
        c = entry[:, t - d] - cum[:, t - d] + duration[:, d - 1].T
        if segment is not None:
            c = c + segment(t, d)
        k = c.argmax(1)
        best[:, t] = np.take_along_axis(c, k[:, None], 1)[:, 0] + cum[:, t]
        length[:, t] = d[k]
        if t < n:
            x = best[:, t, :, None] + (way if pair is None else way + pair(t))
            x[:, diagonal, diagonal] = np.where(length[:, t] == duration.shape[1], best[:, t], -np.inf)
            came[:, t] = x.argmax(1)
            entry[:, t] = x.max(1)
    last = best[:, n].max(1)
    state, at, days = best[:, n].argmax(1), np.full(b, n), np.arange(b)
    lost = np.isneginf(last) | (last < -1e17)  # no segmentation has any probability: the first state
    steps = np.arange(n)
    at[lost] = 0
    while (at > 0).any():
        d = np.where(at > 0, np.maximum(1, length[days, at, state]), 0)
        path = np.where((steps >= (at - d)[:, None]) & (steps < at[:, None]), state[:, None], path)
        at = at - d
        state = np.where(at > 0, came[days, at, state], state)
    return path


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isneginf(top), 0, top)
    with np.errstate(divide="ignore"):
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def marginals(emission: np.ndarray, transition: np.ndarray, duration: np.ndarray, initial: np.ndarray) -> np.ndarray:
    """The probability of each state at each step, over all segmentations of each day of [days, steps, states], or of one."""
    if emission.ndim == 2:
        return marginals(emission[None], transition, duration, initial)[0]
    b, n, s = emission.shape
    way = transition.copy()
    np.fill_diagonal(way, -np.inf)
    cum = np.zeros((b, n + 1, s))
    np.cumsum(emission, 1, out=cum[:, 1:])
    most = min(duration.shape[1], n)
    begin, end = np.full((b, n + 1, s), -np.inf), np.full((b, n + 1, s), -np.inf)  # mass of segments that begin, end at t
    begin[:, 0] = initial
    for t in range(1, n + 1):
        d = np.arange(1, min(most, t) + 1)
        end[:, t] = _lse(begin[:, t - d] - cum[:, t - d] + duration[:, d - 1].T, 1) + cum[:, t]
        if t < n:
            begin[:, t] = _lse(end[:, t, :, None] + way, 1)
    rest, after = np.full((b, n + 1, s), -np.inf), np.full((b, n + 1, s), -np.inf)  # of what follows an end, a beginning
    rest[:, n] = 0
    for t in range(n - 1, -1, -1):
        d = np.arange(1, min(most, n - t) + 1)
        after[:, t] = _lse(rest[:, t + d] + cum[:, t + d] + duration[:, d - 1].T, 1) - cum[:, t]
        rest[:, t] = _lse(way + after[:, t, None, :], 2)
    total = _lse(end[:, n], 1)
    mass = np.zeros((b, n + 1, s))
    for t in range(n):
        d = np.arange(1, min(most, n - t) + 1)
        p = np.exp((begin[:, t] - cum[:, t])[:, None] + duration[:, d - 1].T + cum[:, t + d] + rest[:, t + d] - total[:, None, None])
        mass[:, t] += p.sum(1)
        mass[:, t + d] -= p
    return np.cumsum(mass, 1)[:, :n]


#: Numbers that a batch of days holds in one of the recursion's arrays.
CELLS = 1 << 21


def over_days(rows: DataFrame, keys: list[str], step: str, out: str, work: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], dealt: bool = False) -> DataFrame:
    """Rows (keys, step, emission: an array of nats a state) by days of equal length, many at a time: `work` gets the rows of some days, the rows
    where they begin, and their emissions as [days, steps, states]. Days are dealt over all cores, unless they are already, and their rows sorted by step."""
    sorted_ = (rows if dealt else groups.dealt(rows, keys)).sortWithinPartitions(*keys, step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups.whole(batches, keys):
            flat = table.column("emission").combine_chunks()
            n_states = len(flat[0])
            nats = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_states)
            lengths = np.diff(bounds)
            for n in np.unique(lengths).tolist():
                of = bounds[:-1][lengths == n]
                some = max(1, CELLS // (n_states * n * max(1, min(n, MOST_MINUTES) // 8)))
                for i in range(0, len(of), some):
                    begins = of[i : i + some]
                    at = begins[:, None] + np.arange(n)
                    yield from work(table, begins, nats[at.ravel()].reshape(len(begins), n, n_states)).to_batches()

    return sorted_.mapInArrow(run, out)


#: Fixed values of class locks: steps on each side, steps a minute of a walker, and how many such; km/h that nobody walks; metres of not moving.
LOCK_STEPS, FOOT_STEPS, FOOT_COUNT, WALK_KMH, STILL_SPREAD_M = 2, 30.0, 3, 12.0, 80.0
LOCKS = {"foot": ("walking",), "vehicle": VEHICLES, "stationary": ("stationary",)}


def class_locks(observed: DataFrame, keys: list[str], step: str = "t") -> DataFrame:
    """`observed` (a dense grid: step, lat, lon, cadence) with `lock`: what the steps about one prove. foot: feet move in most of them. vehicle: none has a walker's
    steps, and the first and last fix among them are farther apart than one walks; where there are none, those before and after are. stationary: no
    walker's steps, and the fixes lie together. Null: nothing."""
    order = Window.partitionBy(*keys).orderBy(step)
    about, before = order.rowsBetween(-LOCK_STEPS, LOCK_STEPS), order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc(step)).rowsBetween(Window.unboundedPreceding, -1)  # turned round: a frame up to the end is computed anew for each row
    fix = F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon", F.col(step).alias("t")))
    rows = observed.withColumn("__fix", fix)
    for name, f, w in (("__n", F.last, after), ("__a", F.first, about), ("__b", F.last, about), ("__p", F.last, before)):
        rows = rows.withColumn(name, f("__fix", ignorenulls=True).over(w))
    rows = rows.withColumn("__high", F.sum((F.col("cadence") >= FOOT_STEPS).cast("int")).over(about)).withColumn("__told", F.count("cadence").over(about))
    metres = lambda a, b: geo.haversine(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))
    kmh = lambda a, b: F.when(F.col(f"{b}.t") > F.col(f"{a}.t"), metres(a, b) / (F.col(f"{b}.t") - F.col(f"{a}.t")) * 3.6)
    high = F.coalesce(F.col("__high"), F.lit(0))
    lock = F.when(high >= FOOT_COUNT, "foot").when((high == 0) & (F.coalesce(kmh("__a", "__b"), kmh("__p", "__n")) > WALK_KMH), "vehicle")
    lock = lock.when((high == 0) & (F.col("__told") > 0) & (metres("__a", "__b") < STILL_SPREAD_M), "stationary")
    return rows.withColumn("lock", lock).select(*[c for c in observed.columns if c != "lock"], "lock")


def state_emissions(observed: DataFrame, space: list[State], keys: list[str], step: str) -> list[Column]:
    """The nats of each state at each step, from the columns that the observations have."""
    has, told = set(observed.columns), []
    for s in space:
        e = mode_emission(s.mode, F.col("speed_kmh"), F.col("hr"), F.col("cadence"))
        if "in_bed" in has:
            e = e + bed_emission(s.mode, F.col("in_bed"))
        if s.place is not None:
            e = e + F.coalesce(place_emission(F.col(f"d_{s.place}")), F.lit(0.0))
            if f"implied_kmh_{s.place}" in has:
                e = e + F.coalesce(feasibility(F.col(f"implied_kmh_{s.place}")), F.lit(0.0))
            if f"entry_{s.place}" in has:
                first = F.row_number().over(Window.partitionBy(*keys).orderBy(step)) == 1
                e = e + F.when(first, F.coalesce(F.col(f"entry_{s.place}"), F.lit(0.0))).otherwise(0.0)
        elif s.mode == "stationary":
            e = e - 2.0
        if "lock" in has:
            fits = [k for k, modes in LOCKS.items() if s.mode in modes]
            e = F.when(F.col("lock").isNull() | F.col("lock").isin(*fits) if fits else F.col("lock").isNull(), e).otherwise(float("-inf"))
        told.append(e)
    return told


def decode(observed: DataFrame, keys: list[str], places: list[int] = (), step: str = "t", step_s: int = 60, place_at: dict[int, tuple[float, float]] | None = None, dealt: bool = False) -> DataFrame:
    """Segments of each group's observations: start_ts, end_ts, mode, place. dealt: a key's rows lie in one task, as observations() leaves them.

    observed: t, speed_kmh, hr, cadence; where there, in_bed (boolean), d_<place> (metres to a place), implied_kmh_<place> (the pace that the fixes
    before and after ask for to be there), entry_<place> (nats of entering it, which the day's first step is weighed by) and lock (see class_locks():
    a segment of another class has no probability). With place_at (latitude and longitude of each place; a few, for they are states) the fixes
    (lat, lon) weigh whole segments and what follows what, see context.py. A null says nothing. One group is a day of 1440 steps or fewer; steps are `step_s` long, and durations are scored at that length."""
    space = states(list(places), [])
    way, long = transitions(space), durations(space, step_s=step_s)
    told = state_emissions(observed, space, keys, step)
    seen = [] if place_at is None else [F.col(c).cast("double").alias(f"__{c}") for c in ("lat", "lon", "cadence")]
    rows = observed.select(*keys, F.col(step).cast("long").alias(step), F.array(*told).alias("emission"), *seen)
    begin = np.full(len(space), -math.log(len(space)))
    modes, spots = np.asarray([s.mode for s in space]), [s.place for s in space]
    kinds = {f.name: f.dataType.simpleString() for f in observed.schema}

    def work(table: pa.Table, begins: np.ndarray, emission: np.ndarray) -> pa.Table:
        if place_at is None:
            path = semi_viterbi(emission, way, long, begin)
        else:
            from daygrain.operators.context import place_paths

            at = pa.array((begins[:, None] + np.arange(emission.shape[1])).ravel())
            lat, lon, cadence = (table.column(f"__{c}").take(at).to_numpy(zero_copy_only=False).astype(float).reshape(emission.shape[:2]) for c in ("lat", "lon", "cadence"))
            path = place_paths(lambda t: emission[:, t].T, lat.T, lon.T, cadence.T, space, way, long, begin, step_s, place_at)
        new = np.ones(path.shape, bool)
        new[:, 1:] = path[:, 1:] != path[:, :-1]
        last = np.ones(path.shape, bool)
        last[:, :-1] = new[:, 1:]
        day, i = np.nonzero(new)
        _, j = np.nonzero(last)
        t = table.column(step).to_numpy()
        told = [table.column(k).take(pa.array(begins[day])) for k in keys]
        at = path[day, i]
        return pa.table(
            [*told, pa.array(t[begins[day] + i]), pa.array(t[begins[day] + j] + step_s), pa.array(modes[at].tolist(), pa.string()), pa.array([spots[k] for k in at.tolist()], pa.int64())],
            names=[*keys, "start_ts", "end_ts", "mode", "place"],
        )

    return over_days(rows, keys, step, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", start_ts long, end_ts long, mode string, place long", work, dealt)


def likeliest(observed: DataFrame, keys: list[str], step: str = "t", step_s: int = 60, dealt: bool = False) -> DataFrame:
    """keys, t, mode, p: at each step the mode that is likeliest over all segmentations, and its probability."""
    space = [State(m) for m in MODES]
    way, long, begin = transitions(space), durations(space, step_s=step_s), np.full(len(space), -math.log(len(space)))
    rows = observed.select(*keys, F.col(step).cast("long").alias(step), F.array(*[mode_emission(m, F.col("speed_kmh"), F.col("hr"), F.col("cadence")) for m in MODES]).alias("emission"))
    kinds = {f.name: f.dataType.simpleString() for f in observed.schema}

    def work(table: pa.Table, begins: np.ndarray, emission: np.ndarray) -> pa.Table:
        p = marginals(emission, way, long, begin)
        at = pa.array((begins[:, None] + np.arange(p.shape[1])).ravel())
        told = [table.column(k).take(at) for k in [*keys, step]]
        modes = np.asarray(MODES)[p.argmax(2).ravel()].tolist()
        return pa.table([*told, pa.array(modes, pa.string()), pa.array(p.max(2).ravel())], names=[*keys, step, "mode", "p"])

    return over_days(rows, keys, step, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {step} long, mode string, p double", work, dealt)


#: Net speed of a vehicle's segments in km/h, as mean and deviation.
NET_SPEED = {"cycling": (12, 6), "driving": (22, 12), "train": (28, 14), "plane": (400, 250)}
STRIDE_M, STRIDE_SPREAD, STILL_M, SLOP_M_PER_MIN, LEAST_NATS = 0.75, 0.4, 200.0, 500.0, -6.0


def segment_evidence(mode: Column, displacement_m: Column, slop_s: Column, steps: Column, length_s: Column) -> Column:
    """Nats of a segment's net displacement between the fixes that bracket it, against what its mode predicts: none for a stay, strides for a walk, net
    speed for a vehicle. slop_s: time between those fixes that isn't the segment's, which widens the spread. Never below -6; a null, or a
    mode without a prediction, says nothing."""

    def nats(predicted: Column, sigma: Column) -> Column:
        z = (displacement_m - predicted) / F.sqrt(sigma * sigma + F.pow(SLOP_M_PER_MIN * slop_s / 60, 2))
        return F.greatest(F.lit(LEAST_NATS), -0.5 * z * z)

    walked = F.coalesce(steps, F.lit(0)) * STRIDE_M
    out = F.when(mode == "stationary", nats(F.lit(0.0), F.lit(STILL_M))).when(mode == "walking", nats(walked, F.greatest(walked * STRIDE_SPREAD, F.lit(STILL_M))))
    for m, (mean, spread) in NET_SPEED.items():
        out = out.when(mode == m, nats(length_s / 3.6 * mean, F.greatest(length_s / 3.6 * spread, F.lit(STILL_M))))
    return F.when(displacement_m.isNotNull() & slop_s.isNotNull(), out.otherwise(0.0)).otherwise(0.0)
