"""Grouped kernels over all cores: rows dealt by key into an explicit number of partitions, whole groups many at a time.

Adaptive execution puts small shuffles together by bytes, and a kernel's work isn't in its bytes; a number that is given stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from daygrain.cluster import ship


def width(df: DataFrame) -> int:
    """Partitions for a kernel: the session's shuffle partitions, or its cores where those are more."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a key together, keys over all of the session's partitions. A groupBy on the keys needs no further shuffle. What follows is a kernel,
    so executors get this package."""
    ship(df.sparkSession)
    return df.repartition(width(df), *keys)


def _begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where rows with a new key begin, in sorted rows; nulls are equal."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        codes = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= codes[1:] != codes[:-1]
    return np.append(0, np.flatnonzero(new) + 1)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """For mapInArrow over rows sorted by key: tables of whole groups, as they come, and where each group begins and the last ends."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        begins = _begins(held, keys)
        if len(begins) > 1:
            yield held.slice(0, int(begins[-1])), begins
            held = held.slice(int(begins[-1]))
    if held is not None and held.num_rows:
        yield held, np.append(_begins(held, keys), held.num_rows)
