"""Whole jobs: all rows of each table count, at any number of them."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrain.functions import chance
from daygrain.operators import joins, rail, series
from daygrain.plans import days, rails, slate


def table(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_anti_join_takes_every_order(spark, tmp_path):
    table(spark, tmp_path, "customer", [(1,), (2,), (3,)], "c_custkey long")
    table(spark, tmp_path, "orders", [(1, "1-URGENT", "O"), (2, "5-LOW", "F"), (None, "5-LOW", "F")], "o_custkey long, o_orderpriority string, o_orderstatus string")
    assert [r.c_custkey for r in slate.anti_join(spark, str(tmp_path)).collect()] == [3]


def test_gamma_density_at_its_edge(spark):
    rows = spark.createDataFrame([(0.0,), (-1.0,), (None,), (2.0,)], "x double")
    of = lambda shape: [r.v for r in rows.select(chance.gamma_pdf(F.col("x"), shape, 0.5).alias("v")).collect()]
    two, one, half = of(2.0), of(1.0), of(0.5)
    assert two[:3] == [-math.inf, -math.inf, None] and two[3] == pytest.approx(2 * math.log(0.5) + math.log(2) - 1)
    assert one[0] == pytest.approx(math.log(0.5)) and one[1:3] == [-math.inf, None]
    assert half[:3] == [math.inf, -math.inf, None]


def test_no_frame_runs_to_the_end(spark, capsys):
    """Such a frame is computed anew for each row: a key of 60,000 rows took as many steps for each."""
    x = spark.range(10).selectExpr("id % 2 as k", "id as t", "id as v")
    for df in (joins.nearest_in_time(x.select("k", "t"), x, ["k"], "t", ["v"], 5, "v"), series.filled(x, ["k"], ["t"], "v")):
        df.explain()
        assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_slopes_of_many_lines_at_once():
    t, d = np.array([[0.0, 1, 3], [0, 0, 2], [1, 1, 1]]), np.array([[1.0, 3, 7], [5, 1, 4], [2, 8, 3]])
    v, c, m = rail.theil_sen(t, d)
    assert v.tolist() == [2, 0.5, 0] and c.tolist() == [1, 3, 3] and m.tolist() == [0, 2, 1]
    assert rail.theil_sen(t[1], d[1]) == (0.5, 3, 2)


@pytest.mark.parametrize("query", [days.state_episodes, days.road_match, rails.day_slopes])
def test_no_call_a_group(spark, sf, capsys, query):
    """A pandas call for each state or day costs more than its work."""
    query(spark, sf).explain()
    assert "GroupsInPandas" not in capsys.readouterr().out.replace("network", "")


@pytest.mark.parametrize("query", [days.class_locks, days.day_decode])
def test_steps_of_days_are_not_shuffled(spark, sf, capsys, query):
    query(spark, sf).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_no_lock_looks_to_the_end(spark, sf, capsys):
    days.class_locks(spark, sf).explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_densities_are_those_of_sql_at_any_value(spark, tmp_path):
    """Below 0 the query ended with a division by zero or differed; so did infinity, and numbers below 0 that round to it."""
    values = [None, math.nan, math.inf, -math.inf, 0.0, -1.0, -9.99, -10.0, -10.0001, -15.0, -1000.0, 1e-17, 1e-7, 9.9999999, 9.999999999999998, 10.0, 418.85, 1e15]
    table(spark, tmp_path, "events", [(i, v) for i, v in enumerate(values)], "event_id long, value double")
    events = spark.read.parquet(f"{tmp_path}/events.parquet").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/x/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/x/events.parquet/*.parquet'")
    told = {r[0]: r[1:] for r in db.execute(slate.ORACLES["densities"]).fetchall()}
    bits = lambda row: [None if v is None else repr(v) for v in row]  # noqa: E731  -0.0 isn't 0.0
    assert {r.event_id: bits(r[1:]) for r in slate.densities(spark, f"{tmp_path}/x").collect()} == {k: bits(v) for k, v in told.items()}
