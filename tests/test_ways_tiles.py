"""Legs matched on the network around them, whatever the cells, are matched as on the whole network."""

import numpy as np
import pytest

from daygrain.operators import ways

#: Streets on a grid of about 110 m, with one long road beside it.
GRID = [(f"h{i}{j}", 50 + i * 0.001, 10 + j * 0.0015, 50 + i * 0.001, 10 + (j + 1) * 0.0015) for i in range(12) for j in range(11)]
GRID += [(f"v{i}{j}", 50 + i * 0.001, 10 + j * 0.0015, 50 + (i + 1) * 0.001, 10 + j * 0.0015) for i in range(11) for j in range(12)]
GRID += [("long", 50.0, 10.02, 50.3, 10.02), ("link", 50.0, 10.0165, 50.0, 10.02)]


def tracks():
    rng, out = np.random.default_rng(8), []
    for k in range(12):
        i, j, t = int(rng.integers(0, 8)), int(rng.integers(0, 8)), 0
        for n in range(10):
            out.append((k, t, 50 + i * 0.001 + rng.normal() * 4e-5, 10 + j * 0.0015 + rng.normal() * 5e-5))
            t += 60
            i, j = (i + 1, j) if n % 2 else (i, j + 1)
            i, j = min(i, 11), min(j, 11)
    out += [(50, 60 * n, 50.0 + 0.05 * n, 10.02) for n in range(5)] + [(51, 0, 60.0, 20.0), (51, 60, 60.001, 20.0)]
    return out


@pytest.mark.parametrize("cell_deg", [0.0005, 0.01, 1.0])
def test_matched_as_on_the_whole_network(spark, cell_deg):
    rows = tracks()
    fixes = spark.createDataFrame(rows, "k long, t long, lat double, lon double")
    edges = spark.createDataFrame(GRID, "way_id string, lat1 double, lon1 double, lat2 double, lon2 double")
    got = {r.k: None if r.path is None else [(p.lat, p.lon, p.t) for p in r.path] for r in ways.match_legs(fixes, ["k"], edges, cell_deg=cell_deg).collect()}
    order = sorted(GRID)
    whole = ways.Graph(np.array([g[1:] for g in order]), [g[0] for g in order])
    found = 0
    for k in {r[0] for r in rows}:
        some = sorted(r[1:] for r in rows if r[0] == k)
        t, y, x = (np.array([r[i] for r in some], float) for i in range(3))
        want = ways.match(whole, t, y, x, ways.ROAD)
        assert (got[k] is None) == (want is None)
        if want is not None:
            assert np.allclose(got[k], want)
            found += 1
    assert found >= 8 and got[51] is None


def test_a_leg_meets_only_what_is_around_it(spark):
    fixes = spark.createDataFrame([(1, 0, 50.0001, 10.0), (1, 60, 50.0009, 10.0)], "k long, t long, lat double, lon double")
    far = [(f"f{i}", 51.0 + i, 12.0, 51.001 + i, 12.0) for i in range(20)]
    edges = spark.createDataFrame(GRID + far, "way_id string, lat1 double, lon1 double, lat2 double, lon2 double")
    met = {r.way_id for r in ways.legs_around(fixes, ["k"], edges, ways.ROAD, 0.01).collect()}
    assert "v00" in met and not met & {f[0] for f in far} and len(met) < len(GRID)
    none = ways.match_legs(fixes.limit(0), ["k"], edges)
    assert none.collect() == [] and ways.match_legs(fixes, ["k"], edges.limit(0)).collect()[0].path is None
