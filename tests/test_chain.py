"""What the stations of rides are told by travels once."""

from daygrain.operators import rail


def test_fixes_and_rides_are_dealt_once(spark, sf):
    """One exchange for the spans of a user and one for a day's fixes and rides; there were more than ten."""
    import __spark_entry__

    plan = __spark_entry__.queries()["chain_anchors"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user_id") == 2 and plan.count("Exchange hashpartitioning") == 2


def test_of_fixes_of_one_time_the_first_counts(spark):
    stations = spark.createDataFrame([(i, n, 50.0 + 0.02 * i, 10.0) for i, n in enumerate("ABC")], "station_id long, name string, p_lat double, p_lon double")
    edges = spark.createDataFrame([("Red", i, 50.0 + 0.02 * i, 10.0, 50.02 + 0.02 * i, 10.0) for i in range(2)], "line string, edge_id long, lat1 double, lon1 double, lat2 double, lon2 double")
    net = rail.network(stations, edges)
    rides = spark.createDataFrame([(1, 7, 600, 1200, "Red"), (2, 8, 600, 1200, "Red"), (3, 9, 600, 1200, "Green")], "d long, ride long, start_ts long, end_ts long, line string")
    seen = [(1, 599, 5, 50.0), (1, 599, 4, 50.02), (1, 599, 6, 50.0), (1, 600, 1, 50.0), (1, 1199, 1, 50.04), (1, 1200, 3, 50.0), (1, 1200, 2, 50.04), (4, 5, 1, 50.0)]
    fixes = spark.createDataFrame([(*x, 10.0) for x in seen], "d long, t long, n long, lat double, lon double")
    got = rail.chain_sides(rides, fixes, ["d"], net, tie="n").where("slop_min is not null and anchor > -0.01").collect()
    assert sorted((r.ride, r.side, r["name"], round(r.slop_min, 4)) for r in got) == [(7, "alight", "C", 0.0), (7, "board", "B", round(1 / 60, 4))]
    dark = rail.chain_sides(rides, fixes.where("d > 3"), ["d"], net).select("ride", "name", "anchor", "dwell", "fit", "slop_min").distinct().collect()
    assert {(r.ride, r["name"]) for r in dark} == {(i, n) for i in (7, 8) for n in "ABC"} and {(r.anchor, r.dwell, r.fit, r.slop_min) for r in dark} == {(0.0, 0.0, None, None)}
    # A fix that was seen twice is one on the track; what lies on the line tells of both ends.
    track = spark.createDataFrame([(1, 600 + 60 * i, 50.0 + 0.004 * i, 10.0) for i in range(1, 10)] * 2, "d long, t long, lat double, lon double")
    fits = {(r.side, r["name"]): r.fit for r in rail.chain_sides(rides.where("ride = 7"), track, ["d"], net).collect()}
    assert fits["board", "A"] > -0.1 and fits["alight", "C"] > -0.1 and fits["board", "C"] < -1
    assert fits == {(r.side, r["name"]): r.fit for r in rail.chain_sides(rides.where("ride = 7"), track.distinct(), ["d"], net).collect()}
