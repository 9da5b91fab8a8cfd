"""Segments' evidence and chain context in the recursion, against enumeration of all segmentations with every term by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrain.functions import geo
from daygrain.operators import context, hsmm
from daygrain.operators.hsmm import State
from daygrain.operators.track import haversine
from daygrain.plans import days

PLACES = {1: (50.0, 10.0), 2: (50.03, 10.0)}
LEGS = {"Red": np.array([[50.0, 10.001, 50.03, 10.001]]), "Far": np.array([[51.0, 11.0, 51.1, 11.0]])}
SPACE = [State("walking"), State("driving"), State("unknown"), State("stationary"), State("stationary", 1), State("stationary", 2), State("train", line="Red"), State("train", line="Far"), State("train")]
STEP = 300


def nats(metres, predicted, sigma, slop):
    return max(-6.0, -0.5 * (metres - predicted) ** 2 / (sigma**2 + (500 * slop) ** 2))


def whole(lat, lon, cadence, a, b, mode):
    """Of the segment of steps a to b - 1."""
    i = max((k for k in range(a) if not math.isnan(lat[k])), default=None)
    j = min((k for k in range(b, len(lat)) if not math.isnan(lat[k])), default=None)
    if i is None or j is None or mode == "unknown":
        return 0.0
    m, slop = float(haversine(lat[i], lon[i], lat[j], lon[j])), ((a - i) + (j - b)) * STEP / 60
    if mode == "stationary":
        return nats(m, 0, 200, slop)
    if mode == "walking":
        p = 0.75 * sum(c for c in cadence[a:b] if not math.isnan(c))
        return nats(m, p, max(0.4 * p, 200), slop)
    mean, spread = {"driving": (22, 12), "train": (28, 14)}[mode]
    h = (b - a) * STEP / 3600
    return nats(m, 1000 * mean * h, max(1000 * spread * h, 200), slop)


def chain(lat, lon, t, x, y):
    """Of state y that begins at step t behind state x."""
    i = max((k for k in range(t) if not math.isnan(lat[k])), default=None)
    slop = None if i is None else (t - i) * STEP / 60
    place = lambda p: 0.0 if i is None else nats(float(haversine(lat[i], lon[i], *PLACES[p])), 0, 300, slop)
    out = 0.0
    if y.mode == "stationary":
        return place(y.place) if y.place else 0.0
    if x.mode == "stationary" and x.place and y.mode != "unknown":
        out += place(x.place)
    if y.mode == "train" and y.line:
        at = PLACES[x.place] if x.place else None if i is None else (lat[i], lon[i])
        if at is not None:
            far = min(5000.0, float(context.project(*at, LEGS[y.line])[0].min()))
            out += nats(far, 0, 800, 0.0 if x.place else slop)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_terms_are_those_by_hand(seed):
    rng = np.random.default_rng(seed)
    lat, lon = 50 + rng.uniform(0, 0.05, (3, 7)), 10 + rng.uniform(-0.01, 0.01, (3, 7))
    lat[rng.random((3, 7)) < 0.4] = np.nan
    cadence = np.where(rng.random((3, 7)) < 0.3, np.nan, rng.uniform(0, 600, (3, 7)))
    segment, pair = context.segment_scores(lat, lon, cadence, SPACE, STEP), context.chain_scores(lat, lon, SPACE, STEP, PLACES, LEGS)
    for t in range(1, 8):
        got = segment(t, np.arange(1, t + 1))
        for day in range(3):
            for d in range(1, t + 1):
                assert np.allclose(got[day, d - 1], [whole(lat[day], lon[day], cadence[day], t - d, t, s.mode) for s in SPACE])
        if t < 7:
            got = pair(t)
            for day in range(3):
                assert np.allclose(got[day], [[chain(lat[day], lon[day], t, x, y) for y in SPACE] for x in SPACE])


def test_the_best_segmentation_with_all_terms():
    rng, space, n = np.random.default_rng(1), SPACE[:1] + SPACE[3:7], 5
    way, long = hsmm.transitions(space), hsmm.durations(space, step_s=STEP)[:, :n]
    begin = np.full(len(space), -np.log(len(space)))
    for _ in range(8):
        lat, lon = 50 + rng.uniform(0, 0.05, n), 10 + rng.uniform(-0.01, 0.01, n)
        lat[rng.random(n) < 0.3] = np.nan
        cadence, emission = rng.uniform(0, 600, n), rng.normal(size=(n, len(space))) * 2
        best = -math.inf, None

        def walk(t, before, total, told, lat=lat, lon=lon, cadence=cadence, emission=emission):
            nonlocal best
            if t == n:
                best = max(best, (total, told))
                return
            for k, s in enumerate(space):
                if k != before:
                    first = begin[k] if before is None else way[before, k] + chain(lat, lon, t, space[before], s)
                    for d in range(1, n - t + 1):
                        walk(t + d, k, total + first + emission[t : t + d, k].sum() + long[k, d - 1] + whole(lat, lon, cadence, t, t + d, s.mode), [*told, *[k] * d])

        walk(0, None, 0.0, [])
        got = hsmm.semi_viterbi(emission, way, long, begin, context.segment_scores(lat[None], lon[None], cadence[None], space, STEP), context.chain_scores(lat[None], lon[None], space, STEP, PLACES, {"Red": LEGS["Red"]}))
        assert got.tolist() == best[1]


def test_decode_takes_the_context(spark):
    """An hour without fixes between two places: with the fixes about it, it isn't a stay at the first."""
    rows = [(1, 60 * i, *((50.0, 10.0) if i < 30 else (50.2, 10.0) if i >= 90 else (None, None)), None, 75.0, 0.0, *((0.0, 20_000.0) if i < 30 else (20_000.0, 0.0) if i >= 90 else (None, None))) for i in range(120)]
    seen = spark.createDataFrame(rows, "u long, t long, lat double, lon double, speed_kmh double, hr double, cadence double, d_1 double, d_2 double")
    at = {1: (50.0, 10.0), 2: (50.2, 10.0)}
    got = hsmm.decode(seen, ["u"], [1, 2], place_at=at).orderBy("start_ts").collect()
    assert got[0].start_ts == 0 and got[-1].end_ts == 7200 and all(a.end_ts == b.start_ts for a, b in zip(got, got[1:], strict=False))
    assert (got[0].place, got[0].end_ts, got[-1].place, got[-1].start_ts) == (1, 1800, 2, 5400)


@pytest.mark.parametrize(("seed", "n", "step_s"), [(0, 1, 1800), (1, 5, 1800), (2, 48, 1800), (3, 30, 1800), (4, 9, 14_400), (5, 48, 1800)])
def test_paths_side_by_side_are_those_of_the_recursion(seed, n, step_s):
    rng, b = np.random.default_rng(seed), 40
    space = hsmm.states([1, 2, 3], [])
    at = PLACES | ({3: (50.01, 10.02)} if seed != 3 else {})  # without: a place that isn't told where
    way, long = hsmm.transitions(space), hsmm.durations(space, step_s=step_s)
    begin = np.full(len(space), -np.log(len(space)))
    lat, lon, cadence = 50 + rng.uniform(0, 0.05, (b, n)), 10 + rng.uniform(-0.01, 0.01, (b, n)), rng.uniform(0, 600, (b, n))
    lat[rng.random((b, n)) < 0.8] = np.nan
    lat[0], cadence[rng.random((b, n)) < 0.5] = np.nan, np.nan
    emission = rng.normal(size=(b, n, len(space))) * 2
    emission[rng.random(emission.shape) < 0.1] = -np.inf
    emission[1:9] = np.round(emission[1:9])  # many ties
    emission[2, 0] = -np.inf  # no path at all
    want = hsmm.semi_viterbi(emission, way, long, begin, context.segment_scores(lat, lon, cadence, space, step_s), context.chain_scores(lat, lon, space, step_s, at))
    got = context.place_paths(lambda t: emission[:, t].T, lat.T, lon.T, cadence.T, space, way, long, begin, step_s, at)
    assert got.tolist() == want.tolist()


def test_days_from_fixes_are_those_of_their_observations(spark):
    rng, at = np.random.default_rng(7), {1: (50.0, 10.0), 2: (50.03, 10.0), 5: (50.01, 10.02)}
    some = lambda v, p=0.2: None if rng.random() < p else float(v)
    rows = []
    for k in range(600):
        y, x = at[int(rng.choice([1, 2, 5]))]
        t = int(rng.integers(0, 3 * 86_400))
        rows.append((int(rng.integers(0, 12)), None if k % 97 == 0 else t, some(y + rng.normal() / 500, 0.1), some(x + rng.normal() / 500, 0.1), some(rng.integers(0, 60)), some(rng.integers(50, 140)), None if rng.random() < 0.3 else int(rng.choice([0, 40, 120]))))
    f = spark.createDataFrame(rows, "u long, t long, lat double, lon double, speed_kmh double, bpm double, steps long").withColumn("day_start", F.expr("t - t % 86400"))
    f = f.withColumn("often", F.expr("array(-1d, if(u = 3, null, -2d), -0.5d - u)"))
    seen = hsmm.class_locks(hsmm.observations(f, ["u", "day_start"], 1800, first=("often",)), ["u", "day_start"])
    seen = seen.withColumns({f"entry_{p}": F.get("often", F.lit(k)) for k, p in enumerate(at)} | {f"d_{p}": geo.haversine(F.col("lat"), F.col("lon"), F.lit(y), F.lit(x)) for p, (y, x) in at.items()})
    seen = seen.withColumn("in_bed", F.expr("t - day_start >= 1800 and t - day_start < 21600")).drop("often")
    want = hsmm.decode(seen, ["u", "day_start"], list(at), step_s=1800, place_at=at)
    got = context.decode_fixes(f, ["u", "day_start"], at, "often", (1800, 21_600), 1800)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str) and got.count() > 36


def test_no_step_of_a_day_goes_through_spark(spark, sf, capsys):
    """Steps as rows, their windows and their emissions cost more than decoding them."""
    days.context_decode(spark, sf).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan and "Generate" not in plan
