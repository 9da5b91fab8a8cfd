"""The cascade's kernel: many days a batch are as each by itself; what it sends to tasks is small whatever the fixes."""

import random

import pandas as pd
from pyspark.sql import functions as F

from daygrain.operators import evidence, passes


def days(n):
    """Days of a walk, a ride and stays with fixes that jump about, some with gaps."""
    told = random.Random(3)
    seg, fix, beat = [], [], []
    for u in range(n):
        t, y = 0, 50.0
        for k in range(told.randint(1, 7)):
            mode, end = told.choice(["stationary", "walking", "driving", "train"]), t + told.choice([300, 900, 2400, 5000])
            seg.append((u, t, end, mode, 5, told.choice([None, 4.0, 40.0]), told.choice([None, 0.9]), y, 5.0, told.choice([None, 1, 2])))
            for s in range(t, end, told.choice([60, 240, 1000])):
                y += told.choice([0.0, 0.0001, 0.01])
                fix.append((u, s, y, 5.0, 1.0, told.choice([10.0, 300.0])))
                beat.append((u, s, float(told.choice([0, 3, 90, 120])), told.choice([60.0, 120.0])))
            t = end + told.choice([0, 60, 700])
    return seg, fix, beat


STATIONS = [{"name": f"S{i}", "lat": 50.0 + 0.02 * i, "lon": 5.0, "lines": ["A", "B" if i % 2 else "C"]} for i in range(12)]
SEGMENTS = "u long, start_ts long, end_ts long, mode string, points long, avg_speed double, linearity double, lat double, lon double, place long"
BUT_LINES = evidence.with_evidence()


def test_many_days_a_batch(spark):
    seg, fix, beat = days(60)
    frames = spark.createDataFrame(seg, SEGMENTS), spark.createDataFrame(fix, "u long, t long, lat double, lon double, speed_kmh double, accuracy double"), spark.createDataFrame(beat, "u long, t long, steps double, bpm double")
    out = passes.cascade(frames[0], frames[1], frames[2].select("u", "t", "steps"), ["u"], STATIONS, heart=frames[2].select("u", "t", "bpm"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "InPandas" not in plan  # no call of pandas a day
    got = sorted((r.u, r.start_ts, r.end_ts, r.mode, r.points, tuple(r.kinds)) for r in out.collect())
    names, want = [c.split(" ")[0] for c in SEGMENTS.split(", ")][1:], []
    for u in range(60):
        day = passes.Day(*(pd.DataFrame([r[1:] for r in rows if r[0] == u], columns=c) for rows, c in ((fix, ["t", "lat", "lon", "speed_kmh", "accuracy"]),)), stations=STATIONS)
        day.steps = pd.DataFrame([(t, s) for v, t, s, _ in beat if v == u], columns=["t", "steps"])
        day.heart = pd.DataFrame([(t, b) for v, t, _, b in beat if v == u], columns=["t", "bpm"])
        some = passes.run([dict(zip(names, r[1:], strict=True)) for r in seg if r[0] == u], day, BUT_LINES)
        want += [(u, round(s["start_ts"]), round(s["end_ts"]), s["mode"], int(s.get("points") or 0), tuple(s.get("kinds") or [])) for s in some]
    assert got == sorted(want) and len({r[3] for r in got}) > 4


def test_a_station_is_no_number(spark):
    """A walk between trains is given the name of its station; where places are numbers, it has none."""
    seg = [(1, 0, 600, "train", "Ash", "Elm", 7), (1, 600, 800, "walking", None, None, None), (1, 800, 1400, "train", "Elm", "Oak", None)]
    told = lambda kind: spark.createDataFrame(seg, "u long, start_ts long, end_ts long, mode string, board string, alight string, place long").withColumn("place", F.col("place").cast(kind))
    none = spark.createDataFrame([], "u long, t long, lat double, lon double, speed_kmh double"), spark.createDataFrame([], "u long, t long, steps double")
    got = {kind: [r.place for r in passes.cascade(told(kind), *none, ["u"], passes=(passes.interchange_label,)).orderBy("start_ts").collect()] for kind in ("long", "string")}
    assert got == {"long": [7, None, None], "string": ["7", "Elm", None]}


def test_rails_go_to_the_fixes(spark):
    """Not the other way round, whatever the fixes."""
    rails = spark.createDataFrame([("Red", 50.0, 5.0, 50.01, 5.0), ("Blue", 50.0, 5.0, 50.0, 5.01)], "line string, lat1 double, lon1 double, lat2 double, lon2 double")
    fixes = spark.range(4000).select(F.lit(1).alias("u"), F.col("id").alias("t"), (50.0 + F.col("id") % 10 / 1000).alias("lat"), F.lit(5.0).alias("lon"))
    near = passes.lines_near(fixes, ["u"], rails)
    plan = near._jdf.queryExecution().optimizedPlan().toString() + near._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "RDD" not in plan
    got = {r.t: r.lines for r in near.where("t < 10").collect()}
    assert got[0] == ["Blue", "Red"] and got[9] == ["Red"] and near.count() == 4000
