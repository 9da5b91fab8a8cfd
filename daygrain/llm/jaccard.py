"""The exact side of SimHash near-dedup: candidate pairs are verified by the Jaccard similarity of their shingle sets, and pairs whose
fingerprints lie too far apart to be candidates are found by prefixes, so that none is lost.

Two sets with a similarity of t or more share one of the first n - ceil(t n) + 1 shingles of each, in whatever order all
sets are sorted by. Shingles that a sample shows in many texts come last, so that buckets of a shingle stay small; the
sample changes the cost only, never the result. Pairs that meet are dropped by bounds that hold for every pair of t or
more: their sizes, the places of the shingle they share, and the difference of their counts over 256 cells. What is left
is verified on the whole sets. The first round takes the candidates of fingerprints; the second pairs the texts of a bucket that are
in different components then, so that a group of many near copies isn't paired with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import drop_staged, mapped, slices, staged
from daygrain.llm.graph import components, cross, per_unit

#: Texts of a shingle's bucket that are paired with each other in one block.
BLOCK = 256
#: Cells over which a set's shingles are counted.
CELLS = 256
#: Cells of those that go where texts meet.
COARSE = 128
#: Pairs whose counts are compared at a time.
SOME = 1 << 13
#: Bits of the table that tells texts without a candidate, as a power of two.
BITS = 24


@dataclass(frozen=True)
class Settings:
    """A pair is linked at a similarity of over / under or more. One text of `share` is sampled for common shingles, of few texts at least `least`;
    those in `common` of the sample or more, at most `most_common`, come last in the order."""

    words: int = 5
    over: int = 4
    under: int = 5
    share: int = 32
    least: int = 4000
    common: int = 3
    most_common: int = 1 << 16


def shingles(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending; one of all its words where it has fewer, none without words."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    whole, k = b" ".join(w), min(words, len(w))
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1).tolist()
    begins, digest = [0, *ends[: len(w) - k]], xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(whole[a : b - 1]) for a, b in zip(begins, ends[k - 1 :], strict=True)]), ">u8").astype(np.uint64))


def prefix(x: np.ndarray, common: np.ndarray, s: Settings) -> np.ndarray:
    """The first shingles of a set (ascending) in the order of all: those that aren't common by hash, then the common ones, from the rarest. `common` is
    two rows, hashes in ascending order and their ranks."""
    n = len(x)
    if not n:
        return x
    take = n - -(-s.over * n // s.under) + 1
    if not common.shape[1]:
        return x[:take]
    at = np.minimum(np.searchsorted(common[0], x), common.shape[1] - 1)
    rank = np.where(common[0][at] == x, common[1][at] + np.uint64(1), np.uint64(0))
    return x[np.argsort(rank, kind="stable")[:take]]


def counts(x: np.ndarray) -> bytes:
    """How many shingles of a set fall into each cell, 255 at most: no two sets differ by more than their counts do."""
    return np.minimum(np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _close(ca: np.ndarray, cb: np.ndarray, size: np.ndarray, s: Settings) -> np.ndarray:
    """Which pairs can be as similar as they must be, by the counts and the sum of the sizes of both."""
    return (s.over + s.under) * np.abs(ca - cb).sum(1, dtype=np.int64) <= (s.under - s.over) * size


def _common(texts: DataFrame, n: int, s: Settings) -> np.ndarray:
    """Common shingles of a sample, ascending, with their ranks from the rarest; at most `most_common` rows come to the driver."""
    every = max(1, min(s.share, n // s.least))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                x = np.concatenate([shingles(t, s.words) for t in some.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"x": pa.array(x.view(np.int64))})

    # Of texts with the same words each counts, which at most puts their shingles later.
    seen = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("text").transform(mapped, local, "x long").groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= s.common)
    rows = seen.orderBy(F.desc("n"), "x").limit(s.most_common).collect()
    x = np.asarray([r["x"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(x)
    return np.stack([x[order], (len(x) - 1 - np.arange(len(x))).astype(np.uint64)[order]])


def _table(hashes: DataFrame) -> np.ndarray:
    """A table of bits in which each hash (column h) has its cell set. It tells what surely isn't there; however full, it changes the cost only."""
    cell = F.col("h").bitwiseAND((1 << BITS) - 1)
    words = hashes.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(h & 63))")).alias("bits")).toArrow()
    table = np.zeros(1 << BITS - 6, np.int64)
    table[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def _told(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be there."""
    c = h.view(np.uint64) & np.uint64((1 << BITS) - 1)
    return (table[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sets(texts: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """(node, x): the shingles of the texts that stand in `pairs`. Texts surely in none are told by a table of bits, so that no text is shuffled."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    table = _table(wanted.select(F.col("node").alias("h")))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                some = some.filter(pa.array(_told(table, some.column("node").to_numpy())))
                if some.num_rows:
                    x = [shingles(t, s.words).tobytes() for t in some.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([some.column("row"), some.column("node"), pa.array(x, pa.binary())], ["row", "node", "x"])

    found = texts.select("row", "node", "text").transform(mapped, local, "row long, node long, x binary")
    return found.join(wanted, "node", "left_semi")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, first: DataFrame, s: Settings) -> DataFrame:
    """Those of the pairs (a, b) whose sets are as similar as they must be."""
    both = s.over + s.under

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                ca, cb = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("ca", "cb"))
                size = some.column("size").to_numpy()
                yield some.select(["a", "b"]).filter(pa.array(_close(ca, cb, size, s)))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"s{c}"), F.col("counts").alias(f"c{c}"))
    told = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("sa") + F.col("sb")).alias("size"), "ca", "cb")
    close = staged(told.transform(mapped, near, "a long, b long"), "close")
    sets = staged(_sets(texts, close, s).join(first, ["row", "node"], "left_semi").select("node", "x"), "sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                on = []
                for xa, xb in zip(some.column("xa").to_pylist(), some.column("xb").to_pylist(), strict=True):
                    n = len(np.intersect1d(np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64), assume_unique=True))
                    on.append(both * n >= s.over * (len(xa) + len(xb)) // 8)
                yield some.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    whole = close.join(sets.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
    edges = staged(whole.select("a", "b", "xa", "xb").transform(mapped, exact, "a long, b long"), "links")
    drop_staged(sets)
    return edges


def links(texts: DataFrame, first: DataFrame, candidates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of nodes at the settings' similarity or more. texts: row, node, text; first: row and node,
    one row a node; candidates: pairs (a, b) of nodes that are likely to be linked, of which those that aren't are dropped."""
    s = settings
    both = s.over + s.under
    common = _common(texts, first.count(), s)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                x = [shingles(t, s.words) for t in some.column("text").to_pylist()]
                heads = [prefix(y, common, s).view(np.int64) for y in x]
                yield pa.RecordBatch.from_arrays(
                    [some.column("row"), some.column("node"), pa.array([len(y) for y in x], pa.int32()), pa.array([counts(y) for y in x], pa.binary()), pa.array(heads, pa.list_(pa.int64()))],
                    ["row", "node", "size", "counts", "head"],
                )

    told = texts.select("row", "node", "text").transform(mapped, local, "row long, node long, size int, counts binary, head array<long>")
    nodes = staged(told.join(first, ["row", "node"], "left_semi").drop("row"), "nodes")

    known = _verified(candidates, nodes, texts, first, s)
    shared = nodes.select(F.explode("head").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    table = _table(shared)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column("head")
            n = np.diff(head.offsets.to_numpy())
            token = head.flatten().to_numpy()
            of, pos = np.repeat(np.arange(len(n)), n), np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            on = np.flatnonzero(_told(table, token))
            of = pa.array(of[on])
            coarse = np.minimum(np.frombuffer(b"".join(batch.column("counts").to_pylist()), np.uint8).reshape(-1, COARSE, CELLS // COARSE).sum(2), 255).astype(np.uint8)
            coarse = pa.array([x.tobytes() for x in coarse], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node").take(of), batch.column("size").take(of), pa.array(pos[on], pa.int32()), pa.array(token[on]), coarse.take(of)], ["node", "size", "pos", "token", "coarse"])

    met = nodes.select("node", "size", "head", "counts").transform(mapped, heads, "node long, size int, pos int, token long, coarse binary")
    met = met.join(components(known), "node", "left").withColumn("root", F.coalesce("root", "node"))
    full = met.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("token", "blocks")
    placed = met.join(full, "token").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A text goes to its own block, on side 0, and meets those of other blocks on side 0 of the lower number, on side 1 of the higher.
    to = F.expr("transform(sequence(0, blocks - 1), o -> if(o >= own, named_struct('i', own, 'j', o, 'side', 0), named_struct('i', o, 'j', own, 'side', 1)))")
    kept = ["node", "size", "pos", "root", "coarse"]
    dealt = placed.select("token", F.explode(to).alias("x"), *kept).select("token", "x.*", *kept).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "side")

    def meet(batch: pa.RecordBatch, unit: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, size, pos, root = (batch.column(c).to_numpy().astype(np.int64) for c in kept[:-1])
        cells = np.frombuffer(b"".join(batch.column("coarse").to_pylist()), np.uint8).reshape(-1, COARSE).astype(np.int16)
        # A block's own texts meet each other: they stand on both sides.
        twice = np.flatnonzero(unit[:, 1] == unit[:, 2])
        row, at_side = np.concatenate([np.arange(len(node)), twice]), np.concatenate([side, np.ones(len(twice), side.dtype)])
        number = np.cumsum(np.append(True, (unit[1:] != unit[:-1]).any(1)))[row]
        order = np.lexsort((at_side, number))
        row, at_side = row[order], at_side[order]
        for i, j in cross(unit[row], at_side):
            i, j = row[i], row[j]
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            on = (root[i] != root[j]) & (s.under * low >= s.over * high) & (both * np.minimum(size[i] - pos[i], size[j] - pos[j]) >= s.over * (low + high))
            i, j = i[on], j[on]
            close = [_close(cells[i[k : k + SOME]], cells[j[k : k + SOME]], size[i[k : k + SOME]] + size[j[k : k + SOME]], s) for k in range(0, len(i), SOME)]
            a, b = (node[x[np.concatenate(close)]] if close else node[:0] for x in (i, j))
            if len(a):
                out = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_pydict({"a": pa.array(out[:, 0]), "b": pa.array(out[:, 1])})

    rest = dealt.transform(mapped, per_unit(["token", "i", "j"], meet), "a long, b long").distinct()
    more = _verified(staged(rest, "rest"), nodes, texts, first, s)
    drop_staged(nodes)
    return known.unionByName(more)
