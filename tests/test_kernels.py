"""Kernels on small literal tracks."""

import numpy as np
import pandas as pd

from daygrain.functions import opening
from daygrain.operators import hsmm, passes, track, ways

DEG = 1 / 111_320


def line(n, step_s=60, north_m=0.0, start=0.0):
    t = np.arange(n) * step_s
    return t.astype(float), 51.5 + (start + np.arange(n) * north_m) * DEG, np.full(n, -0.1)


def test_quality_drops_a_teleport():
    t, lat, lon = line(10, north_m=5)
    lat[5] += 0.5
    assert 5 not in track.quality(t, lat, lon, np.full(10, 20.0)) and len(track.quality(t, lat, lon, np.full(10, 20.0))) == 9
    assert list(track.quality(t[:2], lat[:2], lon[:2], np.full(2, 20.0))) == [0, 1]
    acc = np.full(10, 20.0)
    acc[3] = 900
    assert 3 not in track.quality(t, lat, lon, acc)
    assert len(track.quality(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))) == 0


def test_kalman_follows_a_steady_walk():
    t, lat, lon = line(30, step_s=10, north_m=14)
    out = track.kalman(t.astype(int), lat, lon, np.full(30, np.nan))
    assert len(out) == 30 and out.speed_kmh.iloc[0] == 0
    assert 3.5 < out.speed_kmh.iloc[-1] < 6.5 and (out.bearing.iloc[-1] <= 3 or out.bearing.iloc[-1] >= 357)
    assert np.abs(out.lat.to_numpy()[5:] - lat[5:]).max() < 30 * DEG
    same = track.kalman(np.array([0, 0, 60]), lat[:3], lon[:3], np.full(3, 10.0))
    assert list(same.t) == [0, 60]


def test_windows_and_stays():
    assert list(track.windows(np.array([0, 100, 299, 300, 900]))) == [0, 0, 0, 1, 2]
    t = np.concatenate([np.arange(0, 1200, 60), np.arange(1200, 1800, 60), np.arange(1800, 3600, 60)]).astype(float)
    lat = np.concatenate([np.full(20, 51.5), 51.5 + np.arange(1, 11) * 200 * DEG, np.full(30, 51.5 + 2200 * DEG)])
    found = track.mine_stays(t, lat, np.full(len(t), -0.1))
    assert len(found) == 2 and found[0][0] == 0 and found[1][1] == len(t)
    assert track.mine_stays(t[:1], lat[:1], lat[:1]) == []
    of = track.cluster(np.array([51.5, 51.5 + 50 * DEG, 51.51]), np.full(3, -0.1), np.array([100, 100, 100]))
    assert list(of) == [0, 0, 1]


def test_split_and_match():
    hours = np.array([8, 8.2, 8.4, 8.1, 20, 20.2, 20.4, 20.1])
    lat = np.array([51.5] * 4 + [51.5 + 60 * DEG] * 4)
    assert list(track.split_cluster(hours, np.arange(8), lat, np.full(8, -0.1))) == [0] * 4 + [1] * 4
    assert not track.split_cluster(hours, np.zeros(8), lat, np.full(8, -0.1)).any()
    pairs = pd.DataFrame({"old_id": [1, 1, 2], "new_id": [10, 11, 10], "distance_m": [5.0, 6.0, 1.0]})
    assert sorted(map(tuple, track.greedy_match(pairs)[["old_id", "new_id"]].to_numpy().tolist())) == [(1, 11), (2, 10)]


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(1)
    e, a, i = np.log(rng.random((6, 3))), np.log(rng.random((3, 3))), np.log(rng.random(3))
    best = max(product(range(3), repeat=6), key=lambda p: i[p[0]] + e[0, p[0]] + sum(a[p[k - 1], p[k]] + e[k, p[k]] for k in range(1, 6)))
    assert tuple(hsmm.viterbi(e, a, i)) == best


def segmentations(n, states, most):
    if n == 0:
        yield ()
        return
    for d in range(1, min(n, most) + 1):
        for rest in segmentations(n - d, states, most):
            for s in range(states):
                if not rest or rest[0][0] != s:
                    yield ((s, d), *rest)


def test_semi_markov_against_brute_force():
    rng = np.random.default_rng(2)
    n, s, most = 6, 3, 6
    e, a, i, dur = np.log(rng.random((n, s))), np.log(rng.random((s, s))), np.log(rng.random(s)), np.log(rng.random((s, most)))

    def score(seg):
        total, at = i[seg[0][0]], 0
        for k, (x, d) in enumerate(seg):
            total += dur[x, d - 1] + e[at : at + d, x].sum() + (a[seg[k - 1][0], x] if k else 0)
            at += d
        return total

    every = list(segmentations(n, s, most))
    best = max(every, key=score)
    assert list(hsmm.semi_viterbi(e, a, dur, i)) == [x for x, d in best for _ in range(d)]
    w = np.exp([score(x) for x in every])
    want = np.zeros((n, s))
    for seg, p in zip(every, w / w.sum(), strict=True):
        at = 0
        for x, d in seg:
            want[at : at + d, x] += p
            at += d
    assert np.allclose(hsmm.marginals(e, a, dur, i), want)


def test_transitions_forbid_a_jump():
    space = hsmm.states([1, 2], ["red"])
    t = hsmm.transitions(space, {("red", 1)})
    one, two, red = (space.index(hsmm.State("stationary", p)) for p in (1, 2)), None, space.index(hsmm.State("train", line="red"))
    a, b = one
    assert np.isneginf(t[a, b]) and np.isneginf(t[red, b]) and t[red, a] > -np.inf and np.isclose(np.exp(t).sum(1), 1).all() and two is None


def seg(mode, a, b, **more):
    return {"start_ts": a, "end_ts": b, "mode": mode, "points": 10, "avg_speed": 4.0, **more}


def modes(segments):
    return [s["mode"] for s in segments]


def test_passes_on_small_days():
    day = passes.Day()
    stay = lambda a, b, p="home", **m: seg("stationary", a, b, place=p, lat=51.5, lon=-0.1, **m)
    assert len(passes.merge_stays([stay(0, 600), stay(800, 1200)], day)) == 1
    assert len(passes.merge_stays([stay(0, 600), seg("walking", 600, 900, avg_speed=1.5, steps=10), stay(900, 1500)], day)) == 1
    assert len(passes.merge_stays([stay(0, 600), stay(600, 1200, "work")], day)) == 2
    assert passes.merge_moving([seg("walking", 0, 60, way_name="A"), seg("walking", 100, 160, way_name="B")], day)[0]["way_name"] == "A, B"
    assert len(passes.merge_moving([seg("walking", 0, 60, city="X"), seg("walking", 60, 120, city="Y")], day)) == 2
    assert modes(passes.drive_stops([seg("driving", 0, 600), stay(600, 900, steps=2), seg("driving", 900, 1500), stay(1500, 1600, steps=0), seg("driving", 1600, 2000)], day)) == ["driving"]
    train = lambda a, b, x, y, line=None: seg("train", a, b, board=x, alight=y, line=line)
    assert len(passes.interchanges([train(0, 600, "A", "B"), stay(600, 900, None), seg("walking", 900, 1200)], day)) == 2
    assert passes.rail_reconcile([train(0, 600, "A", "B"), train(600, 900, "C", "D")], day)[1]["board"] == "B"
    assert len(passes.merge_same_route([train(0, 600, "A", "B"), train(700, 900, "A", "B", "red")], day)) == 1
    assert passes.interchange_label([train(0, 600, "A", "B"), seg("walking", 600, 800), train(800, 900, "B", "C")], day)[1]["place"] == "B"
    assert modes(passes.repair_handoff([train(0, 600, "A", "B"), seg("driving", 650, 900)], day)) == ["train"]
    assert modes(passes.vehicle_identity([stay(0, 10), seg("driving", 10, 20)], day)) == ["stationary", "vehicle"]
    flip = seg("driving", 0, 300, flipped=True, avg_speed=4.0)
    assert modes(passes.revert_cadence([flip, stay(300, 600)], day)) == ["walking"] + ["stationary"]
    assert modes(passes.revert_cadence([flip, seg("driving", 300, 900)], day))[0] == "driving"
    assert len(passes.rail_journey([train(0, 600, "A", "B", "red"), train(700, 900, "B", "C", "red")], day)) == 1
    assert passes.run([], day) == []


def test_vehicle_leg_in_a_walk():
    t = np.arange(0, 1200, 30.0)
    step = np.where((t >= 300) & (t < 700), 200.0, 30.0)
    f = pd.DataFrame({"t": t, "lat": 51.5 + np.cumsum(step) * DEG, "lon": -0.1, "speed_kmh": 0.0})
    out = passes.vehicle_split([seg("walking", 0, 1170)], passes.Day(fixes=f))
    assert modes(out) == ["walking", "driving", "walking"] and out[1]["start_ts"] >= 240


def test_matching_on_a_grid():
    legs = [[51.5, -0.1 + i * 0.001, 51.5, -0.099 + i * 0.001] for i in range(10)] + [[51.5 + i * 0.001, -0.09, 51.501 + i * 0.001, -0.09] for i in range(10)]
    g = ways.Graph(np.array(legs), list(range(20)))
    lat, lon = np.concatenate([np.full(10, 51.50005), 51.5 + np.arange(1, 10) * 0.001]), np.concatenate([-0.1 + np.arange(10) * 0.001, np.full(9, -0.09004)])
    path = ways.match(g, np.arange(19) * 30.0, lat, lon, ways.ROAD)
    assert path is not None and all(a[2] <= b[2] for a, b in zip(path, path[1:], strict=False))
    assert all(abs(p[0] - 51.5) < 1e-9 or abs(p[1] + 0.09) < 1e-9 for p in path)
    assert ways.match(g, np.arange(2) * 30.0, lat[:2] + 1, lon[:2], ways.ROAD) is None
    assert list(ways.simplify(np.array([0, 0.5, 1.0]) * 0.01 + 51, np.zeros(3), 1.0)) == [0, 2]
    snapped = ways.snap_train(g, np.array([0.0, 300.0]), np.array([51.5, 51.508]), np.array([-0.1, -0.09]))
    assert snapped is not None and snapped[0][2] == 0 and snapped[-1][2] == 300
    assert ways.line_by_stops({"red": [["A", "B", "C"]], "blue": [["A", "C"]]}, "A", "C", 0) == "blue"
    assert ways.in_ring(0.5, 0.5, [(0, 0), (0, 1), (1, 1), (1, 0)]) and not ways.in_ring(2, 0.5, [(0, 0), (0, 1), (1, 1), (1, 0)])
    s = ways.smooth_walk(51.5 + np.array([0, 9, 0, 9, 0]) * DEG, np.full(5, -0.1), np.full(5, 10.0))
    assert np.ptp(s[:, 0]) < 9 * DEG


def test_opening_hours():
    week = opening.parse("Mo-Fr 9:00-17:30; Sa 22:00-2:00; PH off")
    assert week[0] == [(540, 1050)] and week[5] == [(1320, 1560)] and week[6] == []
    assert opening.parse("24/7")[3] == [(0, 1440)] and opening.parse("sunrise-sunset") is None and opening.parse(None) is None
    assert opening.parse("Fr-Mo 10:00-12:00,13:00-15:00")[6] == [(600, 720), (780, 900)] and opening.parse("Tu off") == [[]] * 7
