"""Rides on rails: candidates, robust slopes, the station chain and decoding with the track, on hand-made days and against enumeration."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from daygrain.operators import hsmm, rail, routes
from daygrain.operators.track import haversine

#: Two lines that cross at C, about 1.1 km between stations; X lies on neither, D2 is a second entrance of D.
PLACES = {"A": (50.0, 10.0), "B": (50.01, 10.0), "C": (50.02, 10.0), "D": (50.03, 10.0), "P": (50.02, 9.985), "Q": (50.02, 10.015), "X": (50.5, 10.5)}
LEGS = [("Red", "A", "B"), ("Red", "B", "C"), ("Red", "C", "D"), ("Blue", "P", "C"), ("Blue", "C", "Q")]
FAR = [("Red", (50.2, 10.2), (50.21, 10.2))]  # a part of Red that nothing joins to the rest


@pytest.fixture(scope="module")
def net(spark):
    stations = [(i, n, *p) for i, (n, p) in enumerate(PLACES.items())] + [(90, "D", 50.0302, 10.0002), (91, "Y", 50.2, 10.2), (92, "Z", 50.21, 10.2)]
    edges = [(line, f"{a}{b}", *PLACES[a], *PLACES[b]) for line, a, b in LEGS] + [(line, "far", *a, *b) for line, a, b in FAR]
    return rail.network(
        spark.createDataFrame(stations, "station_id long, name string, p_lat double, p_lon double"),
        spark.createDataFrame(edges, "line string, edge_id string, lat1 double, lon1 double, lat2 double, lon2 double"),
    )


def at(a, b, f):
    (y0, x0), (y1, x1) = PLACES[a], PLACES[b]
    return y0 + f * (y1 - y0), x0 + f * (x1 - x0)


def test_network_tells_stops_and_ways(net):
    stops = {(r.line, r.station_id) for r in net.stops.collect()}
    ids = {n: i for i, n in enumerate(PLACES)}
    assert {s for line, s in stops if line == "Blue"} == {ids["P"], ids["C"], ids["Q"]} and (("Red", ids["X"]) not in stops)
    paths = {(r.line, r.from_id, r.to_id): r.path_m for r in net.paths.collect()}
    assert ("Red", ids["A"], 91) not in paths and ("Blue", ids["A"], ids["Q"]) not in paths
    assert abs(paths["Red", ids["A"], ids["C"]] - float(haversine(*PLACES["A"], *PLACES["C"]))) < 5
    assert paths["Red", 91, 92] > 1000 and paths["Red", ids["D"], 90] == 0.0


def minutes(spark, rows):
    return spark.createDataFrame([(1, m, lat, lon, kmh) for m, (lat, lon), kmh in rows], "d long, m long, lat double, lon double, speed_kmh double")


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        # A ride with observed speed from A to D.
        ([(9, PLACES["A"], 1.0), *((10 + i, at("A", "D", i / 5), 40.0) for i in range(1, 5)), (15, PLACES["D"], 2.0)], {("Red", "A", "D")}),
        # Nothing seen under ground: the way between the last fix and the first tells it.
        ([(8, PLACES["A"], 0.0), (9, PLACES["A"], 0.0), (16, PLACES["D"], 0.0), (17, PLACES["D"], 0.0)], {("Red", "A", "D")}),
        # Too slow for a train.
        ([(8, PLACES["A"], 0.0), (9, PLACES["A"], 5.0), (40, PLACES["D"], 5.0), (41, PLACES["D"], 0.0)], set()),
        # From one line's end to another's: no line joins them.
        ([(8, PLACES["A"], 0.0), (9, PLACES["A"], 0.0), (14, PLACES["Q"], 0.0), (15, PLACES["Q"], 0.0)], set()),
        # A hop of one stop, one fast minute; and a fast minute that comes back to where it was.
        ([(9, PLACES["A"], 1.0), (10, at("A", "B", 0.9), 30.0), (11, PLACES["B"], 1.0)], {("Red", "A", "B")}),
        ([(9, PLACES["A"], 1.0), (10, at("A", "B", 0.1), 30.0), (11, PLACES["A"], 1.0)], set()),
        # No peak.
        ([(9, PLACES["A"], 1.0), (10, PLACES["A"], 13.0), (11, PLACES["A"], 14.0), (12, PLACES["B"], 1.0)], set()),
        ([], set()),
    ],
)
def test_candidates(spark, net, rows, want):
    names = {i: n for i, n in enumerate(PLACES)} | {90: "D", 91: "Y", 92: "Z"}
    got = rail.train_candidates(minutes(spark, rows), ["d"], net).collect()
    assert {(r.line, names[r.board], names[r.alight]) for r in got if r.board < 90 and r.alight < 90} == want


def test_a_long_run_ends_after_ninety_minutes(spark):
    rows = [(m, (50.0 + m * 0.01, 10.0), 60.0) for m in range(100, 240)]
    assert [(r.start_min, r.end_min) for r in rail.ride_windows(minutes(spark, rows), ["d"]).collect()] == [(100, 189)]


def test_slope_stands_a_minority_of_wrong_fixes():
    t = np.arange(9.0)
    d = 5000 - 500 * t
    d[[2, 6]] += 9000
    v, c, m = rail.theil_sen(t, d)
    assert (round(v), round(c), m) == (-500, 5000, 0.0)
    assert rail.theil_sen(np.array([3.0, 3.0]), np.array([1.0, 2.0]))[0] == 0.0 and rail.theil_sen(np.zeros(0), np.zeros(0)) == (0.0, 0.0, 0.0)


def test_chain_is_the_best_of_all_assignments():
    """Days of one to five rides, all assignments of pairs by hand."""
    rng, c = np.random.default_rng(5), rail.Chain()
    for _ in range(60):
        n, rides, rows, start = rng.integers(1, 6), [], [], 0
        for r in range(n):
            start += int(rng.choice([60, 240, 600, 2000]))
            rides.append((r, start, start + 600))
            start += 600
            for _ in range(rng.integers(0 if rng.random() < 0.15 else 1, 5)):
                b, a = rng.integers(0, 5, 2)
                rows.append((r, b, a, f"S{b}", f"S{a}", 50 + b * 0.004, 10.0, 50 + a * 0.004, 10.0, *([-1.0, 0.0, np.nan] * 2), float(rng.normal(-3, 2))))
        names = ["ride", "b_station_id", "a_station_id", "b_name", "a_name", "b_p_lat", "b_p_lon", "a_p_lat", "a_p_lon", "b_anchor", "b_dwell", "b_fit", "a_anchor", "a_dwell", "a_fit", "score"]
        pairs = pd.DataFrame(rows, columns=names)
        got = {g[0]: g for g in rail.resolve(pairs, rides, c)}
        chains, now = [], []
        for r in rides:
            if now and (r[0] not in set(pairs.ride) or r[1] - now[-1][2] > c.chain_gap_s):
                chains, now = [*chains, now], []
            if r[0] in set(pairs.ride):
                now.append(r)
        for chain in [*chains, now]:
            options = [pairs[pairs.ride == r[0]].to_dict("records") for r in chain]
            best, each = -math.inf, [{} for _ in chain]
            for way in itertools.product(*options) if chain else []:
                total = sum(x["score"] for x in way)
                for x, y, p, q in zip(way[:-1], way[1:], chain[:-1], chain[1:], strict=True):
                    m = float(haversine(x["a_p_lat"], x["a_p_lon"], y["b_p_lat"], y["b_p_lon"]))
                    if x["a_name"] != y["b_name"] and m > c.same_m:
                        z = max(0.0, m / max((q[1] - p[2]) / 60, 0.5) - c.walk_m_min) / c.walk_scale
                        total += max(c.chain_floor, -0.5 * z * z)
                best = max(best, total)
                for i, x in enumerate(way):
                    for side in ("b_name", "a_name"):
                        key = side, x[side]
                        each[i][key] = max(each[i].get(key, -math.inf), total)
            for i, r in enumerate(chain):
                _, board, alight, score, *margins = got[r[0]]
                assert abs(score - best) < 1e-9
                for side, name, margin in (("b_name", board, margins[0]), ("a_name", alight, margins[1])):
                    told = sorted((v for k, v in each[i].items() if k[0] == side), reverse=True)
                    want = told[0] - told[1] if len(told) > 1 else math.inf
                    assert margin == want or abs(margin - want) < 1e-9
                    assert (name is not None) == (margin >= c.margin)
        assert set(got) == set(pairs.ride)


def test_chain_names_the_stations_of_a_change(spark, net):
    """From A to C on Red and, three minutes later, from C to Q on Blue, of which C was never seen."""
    rides = spark.createDataFrame([(1, 1, 600, 960, "Red"), (1, 2, 1140, 1320, "Blue")], "d long, ride long, start_ts long, end_ts long, line string")
    seen = [(540, PLACES["A"]), (590, PLACES["A"]), (700, at("A", "C", 0.25)), (800, at("A", "C", 0.55)), (1340, PLACES["Q"]), (1400, PLACES["Q"])]
    fixes = spark.createDataFrame([(1, t, *p) for t, p in seen], "d long, t long, lat double, lon double")
    got = {r.ride: (r.board, r.alight) for r in rail.station_chain(rides, fixes, ["d"], net).collect()}
    assert got[1][0] == "A" and got[2][1] == "Q"
    assert got[1][1] in ("C", None) and got[2][0] in ("C", None)
    none = rail.station_chain(rides.where("line = 'Green'"), fixes, ["d"], net)
    assert none.collect() == []


def test_windows_over_edges_are_the_best_of_all_ways():
    rng = np.random.default_rng(2)
    legs = np.array([[50.0, 10.0, 50.01, 10.0], [50.01, 10.0, 50.02, 10.0], [50.02, 10.0, 50.02, 10.01], [50.01, 10.0, 50.01, 10.01]])
    next_to = routes.neighbours(legs)
    assert [set(r) for r in next_to.tolist()] == [{0, 1, 3}, {0, 1, 2, 3}, {1, 2}, {0, 1, 3}]
    lat, lon = np.array([50.001, np.nan, 50.012, np.nan, 50.02]), np.array([10.0, np.nan, 10.0001, np.nan, 10.009])
    nats, far = routes.edge_nats(lat, lon, legs, np.array([False, True, False, True]))
    assert (nats[1] == [-2.5, 1.5, -2.5, 1.5]).all() and nats[0, 0] > 2
    entry, leave = routes.boundaries(far)
    for some in (nats, rng.normal(size=nats.shape)):
        scores = routes.window_scores(some, next_to, entry, leave, 4)
        for t in range(5):
            for d in range(1, 5):
                a = t - d + 1
                best = -math.inf
                for way in itertools.product(range(4), repeat=d) if a >= 0 else []:
                    if entry[a, way[0]] and leave[t, way[-1]] and all(y in next_to[x] for x, y in zip(way, way[1:], strict=False)):
                        best = max(best, sum(some[a + i, e] for i, e in enumerate(way)))
                assert scores[t, d - 1] == best or abs(scores[t, d - 1] - best) < 1e-9
                if best > -math.inf:
                    path, score = routes.window_path(some[a : t + 1], next_to, entry[a : t + 1], leave[a : t + 1])
                    assert abs(score - best) < 1e-9 and len(path) == d


def test_segment_scores_enter_the_recursion():
    """All segmentations of six steps by hand, with scores of whole segments."""
    rng, n, s = np.random.default_rng(4), 6, 3
    for _ in range(20):
        nats, way, long, extra = rng.normal(size=(n, s)), np.log(rng.dirichlet(np.ones(s), s)), rng.normal(size=(s, n)), rng.normal(size=(n + 1, n + 1, s)) * 3
        begin = np.log(np.full(s, 1 / s))
        best = -math.inf, None

        def walk(t, before, total, told):
            nonlocal best
            if t == n:
                best = max(best, (total, told))
                return
            for k in range(s):
                if k != before:
                    for d in range(1, n - t + 1):
                        x = nats[t : t + d, k].sum() + long[k, d - 1] + extra[t + d, d, k] + (begin[k] if before is None else way[before, k])
                        walk(t + d, k, total + x, [*told, *[k] * d])

        walk(0, None, 0.0, [])
        path = hsmm.semi_viterbi(nats, way, long, begin, lambda t, d: extra[t, d][None])
        assert path.tolist() == best[1]


def test_a_day_on_rails(spark, net):
    """Home, a ride on Red under ground, work: the ride is on Red, and its edges follow each other."""
    edges = net.edges.select("line", "edge_id", "lat1", "lon1", "lat2", "lon2").selectExpr("*", "line = 'Red' AS underground")
    rows = []
    for m in range(60):
        lat, lon = PLACES["A"] if m < 25 else PLACES["D"] if m > 33 else (None, None)
        moving = 25 <= m <= 33
        rows.append((1, 60 * m, lat, lon, None if moving else 0.5, 75.0, 0.0))
    seen = spark.createDataFrame(rows, "d long, t long, lat double, lon double, speed_kmh double, hr double, cadence double")
    got = routes.decode_routes(seen, ["d"], edges).orderBy("start_ts").collect()
    assert got[0].start_ts == 0 and got[-1].end_ts == 3600 and all(a.end_ts == b.start_ts for a, b in zip(got, got[1:], strict=False))
    for r in got:
        assert (r.line is None) == (not r.edges)
        assert r.line is None or len(r.edges) == (r.end_ts - r.start_ts) // 60


def locked(spark, rows):
    seen = spark.createDataFrame([(1, 60 * i, *r) for i, r in enumerate(rows)], "d long, t long, lat double, lon double, cadence double")
    return [r.lock for r in hsmm.class_locks(seen, ["d"]).orderBy("t").collect()]


def test_locks_are_what_steps_and_fixes_prove(spark):
    here, none = (50.0, 10.0), (None, None)
    assert locked(spark, [(*here, 100.0)] * 5) == ["foot"] * 5
    assert locked(spark, [(50.0 + 0.01 * i, 10.0, 0.0) for i in range(5)]) == ["vehicle"] * 5
    assert locked(spark, [(50.0 + 0.01 * i, 10.0, 100.0) for i in range(5)]) == ["foot"] * 5  # feet come first
    assert locked(spark, [(*here, 0.0)] * 5) == ["stationary"] * 5
    assert locked(spark, [(*here, None)] * 5) == [None] * 5  # no step was told
    assert locked(spark, [(*none, 0.0)] * 5) == [None] * 5
    dark = [(*here, 0.0), *[(*none, 0.0)] * 6, (50.1, 10.0, 0.0)]
    assert locked(spark, dark) == ["stationary", *["vehicle"] * 6, "stationary"]
    assert locked(spark, [(*here, 100.0), (*here, 0.0), (*here, 0.0), (*here, 0.0), (*here, 0.0), (*here, 0.0)])[:2] == [None, None]  # one with steps locks nothing


def test_a_locked_segment_keeps_its_class(spark):
    rows = [(1, 60 * i, 5.0 if i < 20 else 40.0, 80.0, 0.0, None if i < 5 else "foot" if i < 20 else "vehicle") for i in range(40)]
    seen = spark.createDataFrame(rows, "d long, t long, speed_kmh double, hr double, cadence double, lock string")
    for s in hsmm.decode(seen, ["d"]).collect():
        inside = {r[5] for r in rows if s.start_ts <= r[1] < s.end_ts} - {None}
        assert all(s.mode in hsmm.LOCKS[k] for k in inside)
    free = {s.mode for s in hsmm.decode(seen.drop("lock"), ["d"]).collect()}
    assert free != {"walking", "driving"}


def test_steps_never_go_through_the_driver(spark, sf):
    """Spark takes a day's steps for fewer than they are; before, it sent all that have a fix to all tasks."""
    import __spark_entry__

    plan = __spark_entry__.queries()["route_decode"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_days_together_are_decoded_as_each_alone():
    rng, (b, n) = np.random.default_rng(6), (5, 12)
    legs = np.array([[50.0, 10.0, 50.01, 10.0], [50.01, 10.0, 50.02, 10.0], [50.02, 10.0, 50.03, 10.0]])
    lines = {"Red": (["x", "y", "z"], legs, np.array([True, True, False])), "Blue": (["w"], legs[:1] + 0.02, np.array([False]))}
    lat = np.where(rng.random((b, n)) < 0.5, np.nan, 50 + rng.random((b, n)) * 0.03)
    lon, nats = np.where(np.isnan(lat), np.nan, 10.0), rng.normal(size=(b, n, len(hsmm.states([], [])))) * 4
    some = routes.route_days(lat, lon, nats, lines, [], 300)
    assert some == [routes.route_days(*(x[i : i + 1] for x in (lat, lon, nats)), lines, [], 300)[0] for i in range(b)]
    assert any(s.line for day in some for *_, s, _ in day)


def test_what_is_known_of_a_ride_travels_once(spark, sf):
    """No station's row is joined by ride, and no pair of stations is dealt; both were, in 49 and 165 exchanges."""
    import __spark_entry__

    for name in ("chain_anchors", "station_chain"):
        plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 20 and plan.count("SortMergeJoin") <= 4
