"""Connected components and the pairwise work of candidate buckets, both without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import drop_staged, staged

#: Pairs that numpy holds at a time.
PAIRS = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long): root is the smallest node of its component.

    Large-star and small-star rounds, each written to the shared folder, until nothing changes. Each round keeps at most as many
    edges as there were; minima are taken with partial aggregation, so a node with very many neighbours is no hot spot."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e, mark, now = staged(e, "edges"), None, None
    while mark is None or now != mark:
        mark = now if now is not None else _mark(e)
        if not mark[0]:
            break
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = staged(large, "large")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, staged(small, "small")
        drop_staged(before, large)
        now = _mark(e)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the edges u-v."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        on = low != high
        if not on.any():
            break
        u, v, low, high = u[on], v[on], low[on], high[on]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def cross(unit: np.ndarray, side: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of the same unit with i on side 0 and j on side 1, some at a time.

    Rows are sorted by unit, then side. Each step gives about `most` pairs at most, or those of one left row."""
    if not len(unit):
        return
    starts = np.flatnonzero(np.append(True, (unit[1:] != unit[:-1]).any(1)))
    ends = np.append(starts[1:], len(unit))
    left = np.add.reduceat((side == 0).astype(np.int64), starts)
    middle, right = starts + left, ends - starts - left
    rows = np.flatnonzero(side == 0)
    owner = np.repeat(np.arange(len(starts)), left)
    n = right[owner]
    total = np.cumsum(n)
    at = 0
    while at < len(rows):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        k = n[at:to]
        i = np.repeat(rows[at:to], k)
        j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(middle[owner[at:to]], k)
        yield i, j
        at = to


def per_unit(units: list[str], work: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows sorted by the columns `units` and side: calls `work` with runs of whole units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(t: pa.Table, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
            for b in t.combine_chunks().to_batches():
                if b.num_rows:
                    yield from work(b, unit, b.column("side").to_numpy(zero_copy_only=False))

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            unit = np.stack([held.column(c).to_numpy() for c in units], 1)
            last = np.flatnonzero((unit[1:] != unit[:-1]).any(1))
            if len(last):
                cut = int(last[-1]) + 1
                yield from done(held.slice(0, cut), unit[:cut])
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from done(held, np.stack([held.column(c).to_numpy() for c in units], 1))

    return run
