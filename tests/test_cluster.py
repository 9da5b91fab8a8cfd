"""Kernels reach executors that don't have the package; tables are cut in the shared folder; a crash between renames loses nothing."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from daygrain import cluster
from daygrain.sources import sinks


ROOT = Path(__file__).resolve().parents[1]
ELSEWHERE = f"""
import sys
from pathlib import Path
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
from daygrain.plans import days
from daygrain.operators import track
print("rows", days.stay_mining(spark, "/root/testdata/sf0.001").count(), days.focus_places(spark, "/root/testdata/sf0.001").count())
"""


def test_kernels_run_where_the_package_is_not_installed(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")} | {"PYSPARK_PYTHON": sys.executable}
    got = subprocess.run([sys.executable, "-c", ELSEWHERE, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    told = [x.split() for x in got.stdout.splitlines() if x.startswith("rows")]
    if not told and ("local-cluster" in got.stderr or "Cannot find" in got.stderr):
        pytest.skip("no local cluster here")
    assert told and all(int(n) > 0 for n in told[0][1:]), got.stderr[-2000:]


def test_staged_tables_stay_what_they_were(spark):
    df = cluster.staged(spark.range(10).selectExpr("id", "rand() AS x"), "test")
    assert df.collect() == df.collect() and df.count() == 10
    cluster.drop_staged(df)


def test_a_crash_between_renames_loses_no_cursor(spark, tmp_path):
    path = str(tmp_path / "cursors")
    sinks.put_cursor(spark, path, "a", "1")
    sinks.put_cursor(spark, path, "b", "2")
    os.rename(path, f"{path}.old")  # as a crash leaves it
    assert sinks.cursor(spark, path, "a") == "1"
    os.rename(path, f"{path}.old")
    sinks.put_cursor(spark, path, "c", "3")
    assert [sinks.cursor(spark, path, k) for k in "abc"] == ["1", "2", "3"]


def test_tiles_stay_if_none_was_fetched(spark):
    old = spark.createDataFrame([("t1", 1), ("t2", 2)], "tile_key string, v long")
    new = spark.createDataFrame([("t1", 9)], "tile_key string, v long")
    done = spark.createDataFrame([("t1", True), ("t2", False)], "tile_key string, ok boolean")
    assert sorted(map(tuple, sinks.rebuilt_tiles(old, new, done).collect())) == [("t1", 9), ("t2", 2)]
    for none in (done.where("not ok"), done.limit(0)):
        with pytest.raises(Exception, match="no tile was fetched"):
            sinks.rebuilt_tiles(old, new, none).collect()
