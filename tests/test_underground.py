"""Rides under ground on a made network: Line 1 runs Alpha, Beta, Gamma, Delta; Line 2 joins Alpha and Delta by another way; Line 3 crosses at Gamma."""

import pandas as pd
import pytest

from daygrain.operators import passes, underground
from daygrain.operators.underground import Fix

STATIONS = [("Alpha", 0, ("Line 1", "Line 2")), ("Beta", 1500, ("Line 1",)), ("Gamma", 3000, ("Line 1", "Line 3")), ("Delta", 4500, ("Line 1", "Line 2"))]


def at(north, east=0.0):
    return 50.0 + north / 111_320, 5.0 + east / 71_555


def day(fixes=(), stations=None):
    told = stations or [{"name": n, "lat": at(y)[0], "lon": at(y)[1], "lines": list(x)} for n, y, x in STATIONS] + [{"name": "Omega", "lat": at(3000, 3000)[0], "lon": at(3000, 3000)[1], "lines": ["Line 3"]}]
    return passes.Day(fixes=pd.DataFrame([(f.t, f.lat, f.lon, 5.0, f.accuracy, sorted(f.lines)) for f in fixes], columns=["t", "lat", "lon", "speed_kmh", "accuracy", "lines"]), stations=told)


def fix(t, north, east=0.0, accuracy=10.0, lines=("Line 1",)):
    return Fix(t, *at(north, east), accuracy, frozenset(lines))


ALPHA, DELTA = fix(0, 0, lines=("Line 1", "Line 2")), fix(900, 4500, lines=("Line 1", "Line 2"))
DARK = [fix(120 + 120 * i, 700 * (i + 1), accuracy=300.0) for i in range(5)]


def test_the_line_is_the_one_that_coarse_fixes_hug():
    assert underground.ride(DARK, ALPHA, DELTA, day())[:3] == ("Line 1", "Alpha", "Delta")
    other = [f._replace(lines=frozenset({"Line 2"})) for f in DARK]
    assert underground.ride(other, ALPHA, DELTA, day()).line == "Line 2"


@pytest.mark.parametrize(
    ("run", "start", "end"),
    [
        (DARK[:1], ALPHA, DELTA),  # too few
        ([f._replace(accuracy=2000.0) for f in DARK], ALPHA, DELTA),  # too coarse to tell
        (DARK, ALPHA, ALPHA._replace(t=900)),  # a wait
        ([f._replace(lines=frozenset()) for f in DARK], ALPHA, DELTA),  # on no line
        (DARK, ALPHA, fix(900, 3000, 3000, lines=("Line 3",))),  # no line serves both ends
        (DARK, fix(0, 20_000), DELTA),  # no station
    ],
)
def test_no_ride(run, start, end):
    assert underground.ride(run, start, end, day()) is None


def test_a_line_that_only_passes_a_station_is_none():
    end = fix(900, 4500, lines=("Line 1", "North Line"))
    run = [f._replace(lines=frozenset({"Line 1", "North Line"})) for f in DARK] + [fix(800, 4200, accuracy=200.0, lines=("North Line",))]
    start = ALPHA._replace(lines=frozenset({"Line 1", "North Line"}))
    assert underground.ride(run, start, end, day()).line == "Line 1"


def test_names_of_shared_tracks():
    assert underground.line_names("Red, Blue and Green Lines") == {"Red Line", "Blue Line", "Green Line"}
    assert underground.line_names("Red Line Eastbound") == {"Red Line"} and underground.line_names("Sand Lines") == {"Sand Lines"}
    shared = [{"name": n, "lat": at(y)[0], "lon": at(y)[1], "lines": []} for n, y, _ in STATIONS]
    start, end = ALPHA._replace(lines=frozenset({"Red and Blue Lines"})), DELTA._replace(lines=frozenset({"Red Line"}))
    run = [f._replace(lines=frozenset({"Red Line"})) for f in DARK]
    assert underground.ride(run, start, end, day(stations=shared)) is None
    assert underground.journey(run, [], start, end, day(stations=shared))[0].line == "Red Line"


def change():
    """Alpha to Gamma on Line 1, up to the sky there, then to Omega on Line 3."""
    start, end = fix(0, 0, lines=("Line 1", "Line 2")), fix(1300, 3000, 3000, lines=("Line 3",))
    run = [fix(100 + 100 * i, 600 * (i + 1), accuracy=300.0) for i in range(5)] + [fix(800 + 100 * i, 3000, 600 * (i + 1), 300.0, ("Line 3",)) for i in range(5)]
    return start, end, run, [fix(650, 3000, lines=("Line 1", "Line 3")), fix(670, 3010, lines=("Line 1", "Line 3"))]


def test_a_change_is_found_where_the_sky_was_seen():
    start, end, run, sky = change()
    found = underground.journey(run, sky, start, end, day())
    assert [r[:3] for r in found] == [("Line 1", "Alpha", "Gamma"), ("Line 3", "Gamma", "Omega")]
    assert underground.journey(run, [], start, end, day()) == []
    away = [f._replace(lat=at(1500)[0]) for f in sky]  # at Beta, where Line 3 isn't
    assert underground.journey(run, away, start, end, day()) == []


def test_surfacings_are_told_by_place_too():
    some = [fix(10, 0), fix(12, 30), fix(14, 1000), fix(16, 1020), fix(700, 1030)]
    assert [len(g) for g in underground.surfacings(some)] == [2, 2, 1]


def test_a_walk_is_cut_around_a_ride():
    walk = [fix(60 * i, -300 + 30 * i, lines=()) for i in range(10)]
    fixes = [*walk, fix(600, 0, lines=("Line 1", "Line 2")), *[f._replace(t=f.t + 600) for f in DARK], DELTA._replace(t=1500), *[fix(1500 + 60 * i, 4500 + 60 * i, lines=()) for i in range(1, 8)]]
    host = {"start_ts": 0, "end_ts": 1920, "mode": "walking", "points": 60, "kinds": []}
    got = underground.underground_rail([host], day(fixes))
    assert [(s["mode"], s["start_ts"], s["end_ts"]) for s in got] == [("walking", 0, 600), ("train", 600, 1500), ("walking", 1500, 1920)]
    assert (got[1]["board"], got[1]["alight"], got[1]["line"]) == ("Alpha", "Delta", "Line 1") and got[1]["kinds"] == ["underground"]
    still = {**host, "mode": "stationary"}
    assert underground.underground_rail([still], day(fixes)) == [still]
    clear = [f._replace(accuracy=10.0) for f in fixes]
    assert underground.underground_rail([host], day(clear)) == [host]


def test_a_change_stays_out_of_both_rides():
    start, end, run, sky = change()
    host = {"start_ts": 0, "end_ts": 1300, "mode": "driving", "points": 10, "kinds": []}
    got = underground.underground_rail([host], day([start, *run[:5], *sky, *run[5:], end]))
    assert [(s["mode"], s.get("line")) for s in got] == [("train", "Line 1"), ("driving", None), ("train", "Line 3")]
    assert got[1]["start_ts"] == 500 and got[1]["end_ts"] == 800 and got[1]["kinds"] == ["underground_change"]


def test_runs_grow_and_stop():
    good = [fix(400, 2000), fix(440, 2010)]
    dark = [fix(0, 0, accuracy=300.0), fix(200, 800, accuracy=300.0), fix(500, 2500, accuracy=300.0)]
    assert [f.t for f in underground.grown(dark[:1], dark, good)] == [0, 200]  # forty seconds of sky end it
    assert [f.t for f in underground.grown(dark[:1], dark, good[:1])] == [0, 200, 500]  # a glimpse doesn't
    blip = [*dark[:2], fix(300, 2000, accuracy=300.0)]
    near = [fix(290, 2000), fix(310, 2010)]
    assert [f.t for f in underground.grown(blip[:1], blip, near)] == [0, 200]
    far = [fix(0, 0, accuracy=300.0), fix(900, 2000, accuracy=300.0)]
    assert len(underground.dark_runs(far, [])) == 1 and len(underground.dark_runs(far, [fix(300, 0), fix(500, 900)])) == 2
    assert len(underground.dark_runs([far[0], far[1]._replace(lat=far[0].lat)], [])) == 2


def test_the_cascade_carves_a_planted_ride(spark):
    fixes = [fix(60 * i, -300 + 30 * i, lines=()) for i in range(10)] + [fix(600, 0)] + [f._replace(t=f.t + 600) for f in DARK] + [DELTA._replace(t=1500)] + [fix(1500 + 60 * i, 4500 + 60 * i) for i in range(1, 8)]
    told = spark.createDataFrame([(1, int(f.t), f.lat, f.lon, 5.0, f.accuracy) for f in fixes], "u long, t long, lat double, lon double, speed_kmh double, accuracy double")
    rails = spark.createDataFrame([("Line 1", *at(a), *at(b)) for a, b in ((0, 1500), (1500, 3000), (3000, 4500))] + [("Line 2", *at(0), *at(2250, 4000)), ("Line 2", *at(2250, 4000), *at(4500))], "line string, lat1 double, lon1 double, lat2 double, lon2 double")
    host = spark.createDataFrame([(1, 0, 1920, "walking", 60, 5.0)], "u long, start_ts long, end_ts long, mode string, points long, avg_speed double")
    steps = spark.createDataFrame([(1, 60 * i, 90.0) for i in range(10)], "u long, t long, steps double")
    stations = day().stations
    got = passes.cascade(host, told, steps, ["u"], stations, rails=rails, passes=(underground.underground_rail,)).orderBy("start_ts").collect()
    assert [(r.mode, r.board, r.alight, r.line) for r in got] == [("walking", None, None, None), ("train", "Alpha", "Delta", "Line 1"), ("walking", None, None, None)]
    assert underground.underground_rail in passes.with_underground()
