"""Streams against batches, sinks and feeds."""

import json

import pytest

from pyspark.sql import functions as F

from daygrain.operators import evaluation, joins, series, states
from daygrain.plans.days import _messages
from daygrain.plans.derived import fixes
from daygrain.sources import feeds, sinks
from daygrain.streaming import motion


def test_motion_stream_is_its_batch(spark, sf, tmp_path):
    m = _messages(fixes(spark, sf))
    m.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = motion.motion_stream(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), idle=None).writeStream.format("memory").queryName("motion").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    key = ["device", "t", "profile", "speed_kmh"]
    got, want = spark.table("motion").select(*key), motion.motion_batch(m).select(*key)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_watermarked_counts(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = motion.insert_ignore(motion.event_time(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))), ["user_id", "ts"])
    q = motion.tumbling(s, ["event_type"], "value").writeStream.format("memory").queryName("tumbling").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    once = e.withColumn("ts", F.col("ts").cast("timestamp")).dropDuplicates(["user_id", "ts"])
    closed = motion.tumbling(once, ["event_type"], "value").where(F.col("end") <= F.lit(once.agg(F.max("ts")).first()[0]) - F.expr("interval 10 minutes"))
    key = ["event_type", "start", "end", "n"]
    got, want = (sorted(map(tuple, x.select(*key).collect())) for x in (spark.table("tumbling"), closed))
    assert len(want) > 100 and got == want


def test_stream_begins_where_the_store_ends(spark, sf, tmp_path):
    """A stream of the later messages, begun with stored fixes, tells what a stream of all would, but for profiles, which aren't stored."""
    m = _messages(fixes(spark, sf)).where("device in ('3', '7', '11')")
    mid = m.agg(F.expr("percentile_disc(0.5) within group (order by t)")).first()[0]
    later, seed = m.where(F.col("t") > mid), m.where(F.col("t") <= mid).select("device", "t", "lat", "lon")
    later.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = motion.seeded(spark.readStream.schema(later.schema).parquet(str(tmp_path / "in")), seed)
    q = motion.motion_stream(stream, idle=None).writeStream.format("memory").queryName("seeded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    key = ["device", "t", "speed_kmh"]
    got = spark.table("seeded").select(*key)
    want = motion.motion_batch(m).where(F.col("t") > mid).select(*key)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_as_of_ties_keep_their_type(spark):
    at = spark.createDataFrame([(1, 10)], "u long, t long")
    r = spark.createDataFrame([(1, 10, 9), (1, 10, 10), (1, 3, 99)], "u long, t long, id long")
    assert joins.as_of(at, r, ["u"], "t", ["id"], "id").first()["asof_id"] == 10
    assert joins.as_of(at, r, ["u"], "t", ["id"], "id", ahead=True).first()["asof_id"] == 9


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "tz")], "k long, v string, tz string")
    new = spark.createDataFrame([(2, "c", "new"), (3, "d", "new")], "k long, v string, tz string")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"], ["tz"]).collect())) == [(1, "a", None), (2, "c", "tz"), (3, "d", "new")]
    path = str(tmp_path / "cursor")
    assert sinks.cursor(spark, path, "x") is None
    sinks.put_cursor(spark, path, "x", "1")
    sinks.put_cursor(spark, path, "y", "2")
    sinks.put_cursor(spark, path, "x", "3")
    assert sinks.cursor(spark, path, "x") == "3" and sinks.cursor(spark, path, "y") == "2"
    a, b = spark.createDataFrame([(1, 5), (2, 6)], "d int, v int"), spark.createDataFrame([(2, 7), (3, 8)], "d int, v int")
    assert sorted(map(tuple, sinks.replace_since(a, b, "d").collect())) == [(1, 5), (2, 7), (3, 8)]


def test_feeds(spark):
    steps = json.dumps({"x": {"dataset": [{"time": "00:01:00", "value": 0}, {"time": "00:02:00", "value": 30}]}})
    df = spark.createDataFrame([("u", "2024-01-02", steps), ("u", "2024-01-03", "not json"), ("u", "2024-01-04", None)], "user string, date string, j string")
    assert [r["steps"] for r in feeds.intraday(df, "j", "x", "steps", ["user"], "date", zero_rows=False).collect()] == [30.0]
    sleep = json.dumps({"logId": 2**60, "startTime": "2024-01-02T23:00:00", "endTime": "2024-01-03T06:00:00", "isMainSleep": True, "minutesAsleep": 400, "levels": {"data": [{"dateTime": "2024-01-02T23:00:00", "level": "deep", "seconds": 600}]}})
    z = spark.createDataFrame([("u", sleep), ("u", "{}")], "user string, j string")
    assert feeds.sleeps(z, "j", ["user"]).first()["log_id"] == 2**60
    assert feeds.main_sleep_stages(feeds.sleeps(z, "j", ["user"]), feeds.sleep_stages(z, "j", ["user"]), ["user"]).count() == 1
    node = json.dumps({"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"highway": "bus_stop", "name": "S"}})
    way = json.dumps({"type": "way", "id": 2, "tags": {"railway": "rail", "highway": "path"}, "geometry": [{"lat": 1, "lon": 2}]})
    rel = json.dumps({"type": "relation", "id": 3, "tags": {"ref": "9"}, "members": [{"type": "node", "ref": 1, "role": "stop"}, {"type": "way", "ref": 2, "role": ""}]})
    m = spark.createDataFrame([(node,), (way,), (rel,), ("x",)], "j string")
    f = feeds.map_features(m, "j")
    assert sorted((r["feature_type"], r["subtype"]) for r in f.collect()) == [("railway", "rail"), ("transit_stop", "bus_stop")]
    assert [(r["route"], r["seq"], r["name"]) for r in feeds.route_stops(feeds.routes(m, "j"), f).collect()] == [("9", 0, "S")]
    assert feeds.plan_backfill({"a": 10, "b": 20, "c": 5}, {"c": 14}, 0, 7) == [("b", 13, 19), ("a", 3, 9)] and feeds.forward_start(None, 10) == 8


def test_joins_on_small_tables(spark):
    p = spark.createDataFrame([(1, 5, 1), (1, 10, 2), (1, 11, 3), (2, 5, 4)], "u long, t long, id long")
    s = spark.createDataFrame([(1, 0, 10), (1, 20, 30)], "u long, start_ts long, end_ts long")
    assert sorted(r["id"] for r in joins.in_interval(p, s, ["u"]).collect()) == [1, 2]
    assert sorted(r["id"] for r in joins.in_interval(p, s, ["u"], closed=False).collect()) == [1]
    assert joins.in_interval(p, s, ["u"], how="left").count() == 3
    z = spark.createDataFrame([(1, 5, 25)], "u long, start_ts long, end_ts long")
    assert sorted(r["overlap_s"] for r in joins.overlapping(s, z, ["u"]).collect()) == [5, 5]
    boxes = spark.createDataFrame([(51.0, 52.0, -1.0, 1.0, 100)], "south double, north double, west double, east double, fetched_ts long")
    at = spark.createDataFrame([(51.5, 0.0), (51.9999, 0.0), (10.0, 10.0)], "lat double, lon double")
    assert joins.covered(at, boxes, 500.0, F.lit(200)).count() == 1
    assert series.sessions(p.limit(0), ["u"], "t", "id", 3).count() == 0
    faults = states.grammar_faults(spark.createDataFrame([(1, 0, 10, "driving", None, None, None), (1, 10, 20, "train", None, "A", "A"), (1, 20, 30, "stationary", "x", None, None), (1, 30, 40, "stationary", "y", None, None)], "u long, start_ts long, end_ts long, mode string, place string, board string, alight string"), ["u"])
    assert sorted(r["fault"] for r in faults.collect()) == ["places_touch", "round_ride", "vehicles_touch"]
    st = spark.createDataFrame([(1, 0, 100, True), (1, 200, 300, True), (1, 50, 400, False)], "u long, start_ts long, end_ts long, inferred boolean")
    assert sorted((r["start_ts"], r["end_ts"]) for r in states.clip_future(st, F.lit(80)).collect()) == [(0, 80), (50, 400)]


def test_tiles_and_saved_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "tile_key string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 8)], "tile_key string, v int")
    done = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "tile_key string, ok boolean")
    assert sorted(map(tuple, sinks.rebuilt_tiles(old, new, done).collect())) == [("a", 9), ("c", 3)]
    with pytest.raises(Exception, match="no tile was fetched"):
        sinks.rebuilt_tiles(old, new, done.where("not ok")).collect()
    path = str(tmp_path / "t")
    sinks.save(old, path)
    sinks.save(spark.read.parquet(path).unionByName(new), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()


def test_verdicts(spark):
    rows = spark.createDataFrame([("correct", True, True), ("correct", True, False), ("wrong", True, True), ("wrong", True, False), ("correct", False, True)], "status string, ok boolean, m boolean")
    got = [r[0] for r in rows.select(evaluation.verdict(F.col("status"), F.col("ok"), F.col("m"))).collect()]
    assert got == ["verified", "regressed", "cleared", "known-error", "unverified"]
