"""Writers: upserts, replaced ranges, cursors and versioned results, on Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], first_writer: list[str] = ()) -> DataFrame:
    """`old` with the rows of `new` put in or over; of the columns `first_writer` a value that is known stays. Keys are distinct on either side."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    there = F.greatest(*[F.col(f"n.{k}").isNotNull().cast("int") for k in keys], F.lit(0)) > 0
    told = [F.coalesce(F.col(f"n.{k}"), F.col(f"o.{k}")).alias(k) for k in keys]
    for c in old.columns:
        if c in keys:
            continue
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        told.append((F.coalesce(a, b) if c in first_writer else F.when(there, F.coalesce(b, a)).otherwise(a)).alias(c))
    return both.select(*told).select(*old.columns)


def replace_since(old: DataFrame, new: DataFrame, date: str) -> DataFrame:
    """`old` before the first date of `new`, then `new`: a source that is swapped for another from a day on."""
    first = new.agg(F.min(date).alias("__first"))
    kept = old.join(first, (F.col("__first").isNull()) | (F.col(date) < F.col("__first"))).drop("__first")
    return kept.unionByName(new)


def replace_children(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` without the rows of any key that `new` has, then `new`: all children of a key are replaced together."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def rebuilt_tiles(old: DataFrame, new: DataFrame, done: DataFrame, tile: str = "tile_key") -> DataFrame:
    """`old` with the tiles that were fetched replaced by what `new` has of them, nothing included; tiles that failed keep what they had.

    done: a row a tile with `ok`. The table's own job fails if none was fetched: a store isn't emptied because its source was away."""
    none = F.raise_error(F.lit("no tile was fetched; the old ones stay")).cast("boolean")
    old = old.where(F.when(done.agg(F.max("ok")).scalar(), F.lit(True)).otherwise(none))
    ok = done.where("ok").select(tile).distinct()
    return old.join(ok, tile, "left_anti").select(*old.columns).unionByName(new.join(ok, tile, "left_semi").select(*old.columns))


def save(df: DataFrame, path: str, parts: list[str] = ()) -> None:
    """Writes a table beside `path` and swaps it in, so that a job which reads what it replaces never reads half of it. The old table is renamed
    aside first, and goes when the new one is in its place: a crash between leaves it there, at <path>.old."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*parts) if parts else df.write
    writer.parquet(fresh)
    aside = of(f"{path.rstrip('/')}.old")
    _restore(spark, path)
    if fs.exists(of(path)):
        fs.delete(aside, True)
        fs.rename(of(path), aside)
    if not fs.rename(of(fresh), of(path)):
        raise OSError(f"{path} can't be put in its place; the new table is at {fresh}")
    fs.delete(aside, True)


def _restore(spark: SparkSession, path: str) -> None:
    """Puts the table that a crash in save() left aside back, where none is in its place."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    here, aside = of(path), of(f"{path.rstrip('/')}.old")
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(here) and not fs.rename(aside, here):
        raise OSError(f"{path}.old can't be put back")


def load_versioned(df: DataFrame, version: str, column: str = "model_version") -> DataFrame:
    """Results of the current version; stale ones count as missing."""
    return df.where(F.col(column) == version).drop(column)


def cursor(spark: SparkSession, path: str, key: str) -> str | None:
    """A stored cursor, or None."""
    _restore(spark, path)
    try:
        row = spark.read.parquet(path).where(F.col("key") == key).select("value").first()
    except Exception as e:  # a table that isn't there yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return row and row[0]


def put_cursor(spark: SparkSession, path: str, key: str, value: str) -> None:
    _restore(spark, path)
    new = spark.createDataFrame([(key, value)], "key string, value string")
    try:
        old = spark.read.parquet(path).where(F.col("key") != key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    save(old.unionByName(new), path)
