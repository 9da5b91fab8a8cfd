"""The stateful processor against the batch, and what only it can do: timers without a message, state that goes by event time, a store to begin with."""

import pytest
from pyspark.sql import functions as F

from daygrain.plans import days
from daygrain.plans.derived import fixes
from daygrain.streaming import motion, states

SCHEMA = "device string, t long, seq long, lat double, lon double, vel double, trigger string, long_stay boolean"


@pytest.fixture(scope="module")
def rocks(spark):
    old = {k: spark.conf.get(k, None) for k in states.CONF}
    for k, v in states.CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run(spark, tmp_path, batches, history=None, **told):
    """Rows of a stream whose micro-batches are these lists of messages."""
    schema = spark.createDataFrame([], SCHEMA).withColumn("ts", F.timestamp_seconds("t")).schema
    for i, rows in enumerate(batches):
        df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, SCHEMA)
        df.withColumn("ts", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = states.motion_states(stream, history, **told).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).orderBy("device", "t").collect()


def test_a_stream_is_its_batch(rocks, sf, tmp_path):
    m = days._messages(fixes(rocks, sf))
    got = sorted((tuple(r)[:6] for r in run(rocks, tmp_path, [m], idle="100 days") if not r.by_timer), key=str)
    assert got == sorted((tuple(r) for r in motion.motion_batch(m).collect()), key=str)


def test_a_hold_ends_without_a_message(rocks, tmp_path):
    still = [("a", t, t, 50.0, 10.0, 0.0, "u" if t == 1000 else None, True) for t in range(1000, 1600, 60)]
    got = run(rocks, tmp_path, [still, [("b", 9000, 1, 50.0, 10.0, 0.0, None, False)], [("b", 9100, 2, 50.0, 10.0, 0.0, None, False)]])
    told = [r for r in got if r.by_timer]
    assert [(r.device, r.t, r.profile) for r in told] == [("a", 1600, "stationary")]


def test_state_goes_by_event_time_and_begins_with_a_store(rocks, tmp_path):
    store = rocks.createDataFrame([("a", 900, 50.0, 10.0), ("a", 100, 0.0, 0.0)], "device string, t long, lat double, lon double")
    first = [("a", 1000, 1, 50.02, 10.0, 0.0, None, False), ("c", 1000, 1, 50.0, 10.0, 0.0, None, False)]
    later = [[("b", 90_000, 1, 50.0, 10.0, 0.0, None, False)], [("b", 90_100, 2, 50.0, 10.0, 0.0, None, False)], [("c", 90_200, 3, 50.02, 10.0, 0.0, None, False)]]
    got = run(rocks, tmp_path, [first, *later], history=store, idle="1 hour")
    assert next(r for r in got if r.device == "a").speed_kmh > 50  # from the stored fix
    assert [r.speed_kmh for r in got if r.device == "c"] == [0.0, 0.0]  # nothing is known of it any more
