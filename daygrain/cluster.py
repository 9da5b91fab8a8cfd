"""What jobs on a cluster need: the package on the executors, and tables in a folder that all share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group that a task collects while it writes a table.
ROW_GROUP_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_daygrain_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="daygrain-")) / "daygrain_pkg.zip"  # the driver's own; Spark hands it on
    atexit.register(shutil.rmtree, at.parent, ignore_errors=True)
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(at))
    sc._daygrain_shipped = True


_made: list[tuple[object, str]] = []


def _remove_all() -> None:
    for fs_path, fs in _made:
        with contextlib.suppress(Exception):
            fs.delete(fs_path, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own in local mode, an error on a cluster.

    The paths are removed when the driver ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: name a folder there that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="daygrain-shared-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/daygrain/{label}-{uuid.uuid4().hex}"
    hadoop_path = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not _made:
        atexit.register(_remove_all)
    _made.append((hadoop_path, hadoop_path.getFileSystem(sc._jsc.hadoopConfiguration())))
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: a cut of the lineage that survives lost executors, so that
    what reads it several times doesn't compute it again."""
    path = scratch(df.sparkSession, label)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Removes the files of tables made by staged() that nothing will read any more."""
    for df in tables:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
