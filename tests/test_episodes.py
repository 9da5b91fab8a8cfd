"""Lines of states: hand-made days, each rule by itself."""

import pytest

from daygrain.operators import episodes


def run(spark, states, fixes, paths=None):
    s = spark.createDataFrame([(1, *x) for x in states], "u long, start_ts long, end_ts long, mode string")
    f = spark.createDataFrame([(1, *x) for x in fixes], "u long, t long, lat double, lon double")
    p = None if paths is None else spark.createDataFrame([(1, a, [{"lat": y, "lon": x, "t": float(t)} for y, x, t in path]) for a, path in paths], "u long, start_ts long, path array<struct<lat:double,lon:double,t:double>>")
    return episodes.episodes(s, f, ["u"], p).orderBy("start_ts").collect()


def lats(row):
    return [round(p.lat, 4) for p in row.points]


def test_a_walk_holds_what_is_too_fast():
    walk = [(50.0 + 0.001 * i, 10.0, 100 * i) for i in range(4)]
    assert episodes.held(walk, 12.0) == walk
    assert episodes.held([(51.0, 10.0, 0), *[(y, x, t + 20) for y, x, t in walk]], 12.0) == [(y, x, t + 20) for y, x, t in walk]  # a straggler ahead
    assert episodes.held([*walk[:2], (50.5, 10.0, 150), *walk[2:]], 12.0) == walk
    assert episodes.held([(51.0, 10.0, 0), (50.0, 10.0, 1)], 12.0) == [(51.0, 10.0, 0)] and episodes.held(walk, None) == walk and episodes.held([], 12.0) == []


def test_spikes_go():
    line = [(50.0 + 0.001 * i, 10.0, i) for i in range(4)]
    assert episodes.without_spikes([*line[:2], (50.5, 10.0, 1), *line[2:]]) == line
    assert episodes.without_spikes(line) == line and episodes.without_spikes(line[:2]) == line[:2]


def test_one_row_a_state(spark):
    got = run(
        spark,
        [(0, 100, "stationary"), (100, 400, "walking"), (400, 500, "unknown"), (500, 600, "sleeping"), (600, 700, "sleeping")],
        [(10, 50.0, 10.0), (50, 50.0002, 10.0), (150, 50.001, 10.0), (250, 50.002, 10.0), (350, 50.003, 10.0), (550, 50.004, 10.0)],
    )
    assert [(r.mode, r.kind, r.seen) for r in got] == [("stationary", "anchor", 2), ("walking", "raw", 3), ("unknown", "tentative", 0), ("sleeping", "anchor", 1), ("sleeping", "anchor", 0)]
    assert lats(got[0]) == [50.0001] and lats(got[1]) == [50.001, 50.002, 50.003] and lats(got[2]) == [50.003, 50.004] and got[4].points == []
    assert got[1].length_m == pytest.approx(222.4, abs=0.2) and got[0].length_m == 0


def test_a_long_gap_stays_open(spark):
    got = run(spark, [(0, 100, "walking"), (100, 200, "unknown"), (200, 300, "walking")], [(10, 50.0, 10.0), (60, 50.0005, 10.0), (210, 50.5, 10.0), (260, 50.5005, 10.0)])
    assert got[1].points == []


def test_a_train_joins_its_neighbours(spark):
    fixes = [(50, 50.0, 10.0), (150, 50.02, 10.0), (250, 50.1, 10.0), (350, 50.2, 10.0)]
    got = run(spark, [(0, 100, "stationary"), (100, 300, "train"), (300, 400, "stationary")], fixes)
    assert lats(got[1]) == [50.0, 50.02, 50.1, 50.2] and got[1].kind == "raw"
    dark = run(spark, [(0, 100, "stationary"), (100, 300, "train"), (300, 400, "stationary")], [fixes[0], fixes[3]])
    assert lats(dark[1]) == [50.0, 50.2]


def test_a_matched_path_is_clipped(spark):
    fixes = [(t, 50.0 + t * 1e-5, 10.0) for t in range(0, 400, 50)]
    path = [(50.0 + t * 1e-5, 10.001, t) for t in range(0, 800, 100)]
    got = run(spark, [(100, 300, "driving"), (300, 400, "walking")], fixes, [(100, path)])
    assert got[0].kind == "matched" and [p.t for p in got[0].points] == [100, 200, 300] and got[1].kind == "raw"
    assert run(spark, [(100, 300, "driving")], fixes, [(100, path[:1])])[0].kind == "raw"


def test_no_rows(spark):
    s = spark.createDataFrame([], "u long, start_ts long, end_ts long, mode string")
    f = spark.createDataFrame([], "u long, t long, lat double, lon double")
    assert episodes.episodes(s, f, ["u"]).collect() == []
