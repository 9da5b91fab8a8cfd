"""What the operators of this subpackage share: reading tables, batches of text in workers, and, from the core, the shared folder and the package on executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrain import cluster
from daygrain.cluster import drop_staged, scratch, staged  # noqa: F401 - operators take them from here

T = TypeVar("T")

#: Bytes of text that a Python step turns into arrays at a time.
SLICE_BYTES = 1 << 20

BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text") -> Column:
    """UTF-8 bytes of a text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def held_out(column: Column, mod: int, rest: int) -> Column:
    """True where crc32 of the id's decimal text leaves `rest` modulo `mod`; a null id is never held out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % mod == rest, F.lit(False))


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application, and bounds the bytes of an Arrow batch unless the session does."""
    if spark.conf.get(BATCH_BYTES[0]) in ("64m", "64MB", "67108864", "67108864b"):  # the default, which a worker with little memory can't hold
        spark.conf.set(*BATCH_BYTES)
    cluster.ship(spark)


def give_back() -> None:
    """Gives memory that a worker no longer uses back to the system, for the next task may be another worker's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """rows.mapInArrow(work, schema), after which each task gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return rows.mapInArrow(run, schema)


_held: dict[str, object] = {}


def held(name: str, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task under this name, made where it isn't there. A worker keeps one thing: what other operators left goes,
    so that a session which runs one after the other needs no more memory than the largest."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of about `most` bytes; a longer row comes alone. No row is lost."""
    if batch.num_rows:
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def strings(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes as strings. Bytes that aren't UTF-8 become U+FFFD, so that a damaged text is read like any other."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode(errors="replace") for x in texts.to_pylist()], pa.string())


def int_bits(value: int) -> int:
    """An unsigned 64-bit number as Spark's signed long."""
    return value - (1 << 64) if value >> 63 else value
