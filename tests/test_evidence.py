"""Cuts and joins on evidence: hand-made days, and cuts where the table's scores say so."""

import numpy as np
import pandas as pd
import pytest

from daygrain.operators import evidence, passes


def day(fixes=(), steps=(), heart=()):
    return passes.Day(
        fixes=pd.DataFrame([(t, y, x, 1.0) for t, y, x in fixes], columns=["t", "lat", "lon", "speed_kmh"]),
        steps=pd.DataFrame(list(steps), columns=["t", "steps"]), heart=pd.DataFrame(list(heart), columns=["t", "bpm"]),
    )


def stay(a, b, **told):
    return {"start_ts": a, "end_ts": b, "mode": "stationary", "points": 10, "lat": 50.0, "lon": 10.0, "kinds": [], **told}


HOME = [(60 * i, 50.0, 10.0) for i in range(10)]
LATER = [(4140 + 60 * i, 50.001, 10.0) for i in range(5)]
WALK = [(600 + 60 * i, 80.0) for i in range(50)]


@pytest.mark.parametrize(
    ("gap", "gaps", "fixes", "steps", "bpm", "away", "want"),
    [
        (3600, [60] * 9, 10, 3000, [], 200, 4.5),  # a walk, in a gap sixty times as long as others
        (3600, [300] * 9, 10, 3000, [], 200, 4.0),
        (3600, [60] * 3, 4, 3000, [], 200, 3.5),  # too few fixes to tell what is usual
        (3600, [], 1, 30, [60.0] * 3, 5, -3.0),  # sitting
        (3600, [60] * 9, 10, 600, [120.0] * 3, 200, 3.8),
        (3600, [60] * 9, 10, 100, [100.0] * 3, 200, -0.2),
        (3600, [60] * 9, 10, 3000, [120.0] * 2, 200, 4.5),  # too few beats
        (0, [], 1, 0, [], 0, 0.0),
    ],
)
def test_scores(spark, gap, gaps, fixes, steps, bpm, away, want):
    from pyspark.sql import functions as F

    assert abs(evidence.score(gap, gaps, fixes, steps, np.array(bpm), away) - want) < 1e-9
    row = spark.range(1).select(evidence.split_score(*(F.lit(x) if x is not None else F.lit(None).cast("double") for x in (gap, float(np.median(gaps)) if gaps else None, fixes, steps, len(bpm), float(np.mean(bpm)) if bpm else None, away))).alias("s")).first()
    assert abs(row["s"] - want) < 1e-9


def test_a_stay_is_cut_where_its_owner_left():
    got = evidence.split_stays([stay(0, 4380)], day(HOME + LATER, WALK))
    assert [(s["mode"], s["start_ts"], s["end_ts"]) for s in got] == [("stationary", 0, 540), ("unknown", 540, 4140), ("stationary", 4140, 4380)]
    assert [s["points"] for s in got] == [10, 0, 5] and got[0]["kinds"] == ["stay_split"]
    for same in (day(HOME + LATER), day(HOME + LATER, [(700, 5.0)]), day(HOME), day()):
        assert evidence.split_stays([stay(0, 4380)], same) == [stay(0, 4380)]
    ride = {**stay(0, 4380), "mode": "driving"}
    assert evidence.split_stays([ride], day(HOME + LATER, WALK)) == [ride]


def test_a_cut_begins_a_new_run():
    """After a cut nothing is usual yet: the second gap has no fixes before it that tell how long gaps are."""
    third = [(9000 + 60 * i, 50.002, 10.0) for i in range(3)]
    slow = WALK + [(4500 + 60 * i, 10.0) for i in range(70)]  # 2 nats, 3 with a long run before
    got = evidence.split_stays([stay(0, 9120)], day(HOME + LATER[:2] + third, slow))
    assert [s["mode"] for s in got] == ["stationary", "unknown", "stationary"]


def test_a_sit_in_a_walk():
    walk = {**stay(0, 3600), "mode": "walking"}
    steps = [(60 * i, 100.0) for i in range(20, 40)]
    got = evidence.split_walks([walk], day(steps=steps))
    assert [(s["mode"], s["start_ts"], s["end_ts"]) for s in got] == [("stationary", 0, 1200), ("walking", 1200, 2400), ("stationary", 2400, 3600)]
    for other in ([(60 * i, 100.0) for i in range(60)], [(60 * i, 20.0) for i in range(20, 40)], [(60 * 20, 100.0)], []):
        assert evidence.split_walks([walk], day(steps=other)) == [walk]
    short = {**walk, "end_ts": 1100}
    assert evidence.split_walks([short], day(steps=steps)) == [short]


def test_stays_at_rest_are_joined():
    a, b = stay(0, 600), stay(900, 1500)
    calm = [(620 + 60 * i, 65.0) for i in range(4)]
    assert evidence.bridge_stays([a, b], day(heart=calm)) == [{**a, "end_ts": 1500, "points": 20}]
    for apart in (day(), day(heart=calm[:2]), day(heart=[(t, 100.0) for t, _ in calm]), day(heart=calm, steps=[(700, 12.0)])):
        assert evidence.bridge_stays([a, b], apart) == [a, b]
    assert evidence.bridge_stays([a, stay(1300, 1500)], day(heart=calm)) == [a, stay(1300, 1500)]
    assert evidence.bridge_stays([a, {**b, "lat": 50.01}], day(heart=calm)) == [a, {**b, "lat": 50.01}]
    assert evidence.bridge_stays([a, {**b, "lat": None}], day(heart=calm)) == [a, {**b, "lat": None}]
    close = stay(600, 900)
    assert len(evidence.bridge_stays([a, close, stay(900, 950)], day())) == 1
    assert evidence.bridge_stays([a, close], day(heart=[(100, 140.0), (700, 150.0)])) == [a, close]
    chain = evidence.bridge_stays([a, {**close, "lat": 50.001}, {**stay(900, 950), "lat": 50.002}], day())
    assert [s["end_ts"] for s in chain] == [900, 950]  # places are compared with the first


def test_the_cascade_cuts_first(spark):
    fixes = spark.createDataFrame([(1, t, y, x, 1.0) for t, y, x in HOME + LATER], "u long, t long, lat double, lon double, speed_kmh double")
    steps = spark.createDataFrame([(1, int(t), n) for t, n in WALK], "u long, t long, steps double")
    heart = spark.createDataFrame([(1, 700, 100.0)], "u long, t long, bpm double")
    host = spark.createDataFrame([(1, 0, 4380, "stationary", 15, 50.0, 10.0)], "u long, start_ts long, end_ts long, mode string, points long, lat double, lon double")
    got = passes.cascade(host, fixes, steps, ["u"], heart=heart, passes=evidence.BEFORE).orderBy("start_ts").collect()
    assert [(r.mode, r.start_ts, r.end_ts) for r in got] == [("stationary", 0, 540), ("unknown", 540, 4140), ("stationary", 4140, 4380)]
    assert evidence.with_evidence()[:3] == evidence.BEFORE
