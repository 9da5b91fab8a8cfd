"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash; a document's virtual finish time is the cumulative size of its source up
to its own end, divided by the source's target. All documents are range-sorted by finish time and taken until the total
budget is spent. Running sums are made in two levels: an order, of a source or of all, is cut into ranges, whose sums give each
range its offset, so that neither a source nor the whole is gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.llm.common import ship, staged

#: Rows that a range of an order holds about, in small tables; in large ones the square root of all, so that neither a range nor the number of ranges is.
RANGE_ROWS = 8192


@dataclass(frozen=True)
class Mix:
    """weights: by the sources' code-point order, null last, repeating. share: budget as a part of all sizes. most: epochs, the times that a document can be taken."""

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    most: int = 2


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Shares `budget` by weight; a target stops at `most` times its size, the excess is shared again until none is above."""
    caps = [float(most * s) for s in sizes]
    out = [0.0] * len(sizes)
    open_ = list(range(len(sizes)))
    left = budget
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        full = [i for i in open_ if share[i] > caps[i]]
        if not full:
            for i in open_:
                out[i] = share[i]
            break
        for i in full:
            out[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if share[i] <= caps[i]]
    return out


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Per source (source, source_size, n_rows, target). One row a source comes to the driver, where the excess is shared again."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(rows))]
    goal = targets([r["source_size"] for r in rows], weights, mix.share * sum(r["source_size"] for r in rows), mix.most)
    return sizes.sparkSession.createDataFrame(
        [(r["source"], r["source_size"], r["n_rows"], t) for r, t in zip(rows, goal, strict=True)],
        "source string, source_size bigint, n_rows bigint, target double",
    )


def mixed(sizes: DataFrame, mix: Mix = Mix(), seed: str = "mix") -> DataFrame:
    """One row for each taken copy of a document: row_id, doc_id, source, size, epoch, finish, taken, source_size, target; and
    rows with taken 0 for copies behind the budget. sizes: row_id (distinct), doc_id, source, size.

    Ties in the hash are broken by doc_id, size, then row_id; a null doc_id sorts first. The copy that crosses the budget is taken in
    part. Sources or documents without words take 0. An empty table gives an empty table."""
    spark = sizes.sparkSession
    goals = source_targets(sizes, mix)
    n = goals.agg(F.sum("n_rows")).first()
    spread = lambda rows: max(1, -(-rows // max(RANGE_ROWS, isqrt(rows))))
    order = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    by = ["order", "doc_id", "size", "row_id"]  # rows with one id are spread like any others
    docs = sizes.withColumn("order", order).repartitionByRange(spread(n[0] or 0), "source", *by)
    docs = staged(docs.withColumn("cell", F.spark_partition_id()), "orders")
    by_cell = docs.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    above = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    offsets = by_cell.withColumn("before", F.coalesce(F.sum("cell_size").over(above), F.lit(0))).drop("cell_size")
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    placed = docs.join(offsets, same(docs, offsets, "source", "cell")).select(docs["*"], "before")
    within = Window.partitionBy("cell", "source").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("cum", F.col("before") + F.sum("size").over(within))
    placed = placed.join(goals, placed["source"].eqNullSafe(goals["source"])).select(placed["*"], "source_size", "target")
    copies = placed.withColumn("epoch", F.explode(F.array(*[F.lit(i) for i in range(mix.most)])))
    done = F.col("cum") + F.col("epoch") * F.col("source_size")
    copies = copies.withColumn("finish", F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(float("inf"))))
    copies = copies.select("row_id", "doc_id", "source", "size", "epoch", "finish", "source_size", "target")
    key = ["finish", "doc_id", "size", "row_id", "epoch"]
    ranged = staged(copies.repartitionByRange(spread((n[0] or 0) * mix.most), *key).withColumn("range", F.spark_partition_id()), "mix")
    per_range = ranged.groupBy("range").agg(F.sum("size").alias("range_size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    starts = per_range.withColumn("range_start", F.coalesce(F.sum("range_size").over(before), F.lit(0))).drop("range_size")
    budget = goals.agg(F.coalesce(F.floor(F.sum("target") + 0.25), F.lit(0))).first()[0]  # halves go down, whatever the sum's last bit
    run = Window.partitionBy("range").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(starts, "range").withColumn("run", F.col("range_start") + F.sum("size").over(run))
    room = F.lit(int(budget)) - (F.col("run") - F.col("size"))
    return out.withColumn("taken", F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), room))).drop("range", "range_start", "run")


def _sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """Rows get a number of their own, kept in a written table, so that repeated documents stay apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return staged(rows.withColumn("row_id", F.monotonically_increasing_id()), "sizes")


def allot(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", mix: Mix = Mix()) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    ship(docs.sparkSession)
    copies = mixed(_sizes(docs, id_col, source_col, text_col), mix)
    first = lambda c: F.first(c).alias(c)
    out = copies.groupBy("row_id").agg(first("doc_id"), first("size"), first("source_size"), first("target"), F.sum("taken").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", mix: Mix = Mix()) -> DataFrame:
    """The rows of `docs`, each as many times as the mix takes it (a copy of which a part is taken counts as one). Columns stay as they are;
    rows without words are never taken."""
    ship(docs.sparkSession)
    mark = "__row"
    while mark in docs.columns:
        mark += "_"
    kept = staged(docs.withColumn(mark, F.monotonically_increasing_id()), "docs")
    sizes = kept.select(F.col(mark).alias("row_id"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    times = mixed(sizes, mix).where("taken > 0").groupBy("row_id").agg(F.count("*").cast("int").alias("__times"))
    out = kept.join(times, kept[mark] == times["row_id"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return out.select(*docs.columns)
