"""Harmonic packing of documents into sequences of a fixed number of tokens.

A document's ids are cut into whole sequences and a rest; the rest is cut where its reciprocal class (the k of
capacity // k) would leave padding. Every class k fills its bins with k pieces, whichever task they come from: a piece's
place in its class follows from counts per input partition and class, so no class is gathered anywhere. The pieces of each
class's last, unfilled bin (fewer than k) are put together over all classes by first fit.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from daygrain.llm import tokens
from daygrain.llm.common import mapped, ship, slices, staged, text_column

CAPACITY = 4096
#: Up to this many pieces a bin every reciprocal is a class, beyond it steps of an eighth are.
CLASSES = 64
#: A rest is cut when its class would pad more than this part of the slot, and more than so many tokens.
WASTE, SPARE = 0.01, 8


@lru_cache(maxsize=8)
def classes(capacity: int = CAPACITY) -> tuple[int, ...]:
    """The numbers of pieces that a class's bins take, ascending."""
    ks = list(range(1, min(CLASSES, capacity) + 1))
    while ks[-1] + ks[-1] // 8 <= capacity and ks[-1] >= CLASSES:
        ks.append(ks[-1] + ks[-1] // 8)
    return tuple(ks)


def class_of(length: int, capacity: int = CAPACITY) -> int:
    """The largest class whose slot, capacity / k, holds `length` tokens."""
    ks = classes(capacity)
    return ks[bisect_right(ks, capacity // max(1, length)) - 1]


def cuts(total: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces, in order: whole sequences, then the rest, cut to slots where padding would be left."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = class_of(rest, capacity)
        slot, smaller = capacity // k, capacity // (k + 1)
        if slot - rest <= max(WASTE * slot, SPARE):
            out.append(rest)
            break
        out.append(smaller)
        rest -= smaller
    return out


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, most_kept: int) -> DataFrame:
    """Per piece of each row: doc_id, where it starts, its length, checksum and class, and its number among those of its class and partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = tokens.encoder(tokens.public(tokenizer), False, most_kept), TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        count = dict.fromkeys(classes(capacity), 0)
        for batch in batches:
            for some in slices(batch, tokens.BATCH_BYTES):
                rows = []
                for i, ids in enumerate(encoder.encode_all(some.column("text"))):
                    ids += end
                    at, total = 0, len(ids) // 4
                    for n in cuts(total, capacity):
                        k = class_of(n, capacity)
                        rows.append((i, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, k, part, count[k]))
                        count[k] += 1
                        at += n
                of, *columns = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                yield pa.record_batch([some.column("doc_id").take(of), *columns], ["doc_id", *NUMBERS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs, cut, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS))


NUMBERS = ("start", "length", "ids_crc32", "doc_tokens", "k", "part", "nth")


def first_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length, longest first."""
    room: list[int] = []
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        j = next((j for j, r in enumerate(room) if r >= lengths[i]), len(room))
        if j == len(room):
            room.append(capacity)
        room[j] -= lengths[i]
        out[i] = j
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY, most_kept: int = tokens.MOST_KEPT) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (from 0, gapless), offset.

    A null or empty text is its end id alone. Rows with the same id, or a null id, are packed one by one. Columns besides the two
    are not read. An empty table gives an empty table. Bytes that aren't UTF-8 count as U+FFFD. most_kept: runs whose ids a worker remembers, at about 40 bytes each."""
    spark = docs.sparkSession
    ship(spark)
    pieces = staged(_pieces(docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text")), tokenizer, end_id, capacity, most_kept), "pieces")
    counts = pieces.groupBy("k", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row an input partition
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    totals = sorted((r["k"], r["n"]) for r in pieces.groupBy("k").agg(F.count("*").alias("n")).collect())  # a row a class
    full, begin = 0, {}
    for k, n in totals:
        begin[k] = full
        full += n // k
    frame = spark.createDataFrame([(k, n // k, begin[k]) for k, n in totals], "k long, bins long, begin long")
    placed = pieces.join(counts.join(frame, "k").select("k", "part", "base", "bins", "begin"), ["k", "part"])
    placed = placed.withColumn("rank", F.col("base") + F.col("nth")).withColumn("bin", F.floor(F.col("rank") / F.col("k")))
    inside = placed.where("bin < bins").withColumn("sequence_id", F.col("begin") + F.col("bin"))
    # Fewer than k pieces of each class are left; their number has a bound that only the capacity sets.
    told = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    left = placed.where("bin >= bins").select(*told, "rank", "k").collect()
    left.sort(key=lambda r: (-r["length"], r["k"], r["rank"]))
    bins = first_fit([r["length"] for r in left], capacity)
    rest = spark.createDataFrame(
        [(*(r[c] for c in told), full + b, i) for i, (r, b) in enumerate(zip(left, bins, strict=True))],
        StructType([*(pieces.schema[c] for c in told), StructField("sequence_id", LongType()), StructField("rank", LongType())]),
    )
    both = inside.select(*told, "sequence_id", "rank").unionByName(rest)
    before = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` pieces
    return both.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("rank")
