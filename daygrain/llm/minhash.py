"""Document fingerprints by MinHash.

A text's shingles of five words (all its words where it has fewer; none without words) are hashed to 32 bits and put
through `perms` universal permutations a x + b modulo 2**32, a odd, in numpy; a fingerprint holds the low 16 bits of each
minimum. The share of equal places estimates the Jaccard similarity of two texts' shingles. Near-duplicates are found by
joining bands of the signatures in Spark; each pair that meets is verified by the exact Jaccard similarity.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import give_back, mapped, ship, slices, staged, strings
from daygrain.llm.graph import components, cross, forest, per_unit

#: Shingles that are permuted at a time.
CHUNK = 4096
#: Distinct texts of a band's bucket that are compared with each other in one block.
BLOCK = 256
#: Bytes of text that a range of ids holds about.
RANGE_BYTES = 16 << 20


@dataclass(frozen=True)
class Settings:
    """bands * rows permutations are joined: at a similarity of 0.8 a pair is missed with a probability of 0.002."""

    words: int = 5
    perms: int = 128
    bands: int = 21
    rows: int = 6
    similarity: float = 0.8
    seed: int = 1


@lru_cache(maxsize=8)
def permutations(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    return rng.integers(0, 1 << 31, s.perms).astype(np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, s.perms, dtype=np.uint64).astype(np.uint32)


def shingles(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's shingles, in order, repeats included. A-Z count as a-z."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(zlib.crc32, w), np.uint64, len(w))
    k = min(words, len(w))
    x = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        x = (x + h[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def signature(x: np.ndarray, s: Settings) -> np.ndarray:
    """The minima of the permutations over hashed shingles; all ones where there are none."""
    a, b = permutations(s)
    least = np.full(s.perms, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), CHUNK):
        y = x[i : i + CHUNK, None] * a
        y += b
        np.minimum(least, y.min(0), out=least)
    return least


def short(sig: np.ndarray) -> np.ndarray:
    return sig.astype(np.uint16)


def hexed(sig: np.ndarray) -> str:
    return short(sig).astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal places of two fingerprints."""
    return float((short(a) == short(b)).mean())


def fingerprints(text: Column, settings: Settings = Settings()) -> Column:
    """The fingerprint of a text, 4 hexadecimal digits a permutation; a null text has that of an empty one."""

    @F.arrow_udf("string")
    def of(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in chunks:
            parts = slices(pa.record_batch([chunk], ["text"]))
            yield pa.array([hexed(signature(shingles(t, settings.words), settings)) for some in parts for t in some.column(0).to_pylist()], pa.string())
        give_back()

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row of `docs`: doc_id, class_id, the smallest id reachable over pairs of texts with a Jaccard similarity of `similarity` or more
    that share a band of their signatures.

    Texts with the same words are one node, so copies aren't paired. Texts without words are one class. Null ids name no class unless
    it holds no other. Repeated rows stay. A bucket of many texts is compared in blocks, each in a task of its own."""
    s, spark = settings, docs.sparkSession
    ship(spark)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                node, bands, sets = [], [], []
                for t in some.column("text").to_pylist():
                    words = t.lower().split()
                    x = np.unique(shingles(t, s.words))
                    sig = signature(x, s)[: s.bands * s.rows].reshape(s.bands, s.rows)
                    node.append(int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True))
                    bands.append([int.from_bytes(hashlib.blake2b(row.tobytes(), digest_size=8, salt=i.to_bytes(8, "little")).digest(), "little", signed=True) for i, row in enumerate(sig)])
                    sets.append(x.tobytes())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(node, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "node", "bands", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = staged(texts.transform(mapped, local, f"doc_id {kind}, node long, bands array<long>, shingles binary"), "minhash")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    nodes = staged(nodes, "nodes")
    met = nodes.select("node", F.explode("bands").alias("band"))
    full = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = met.join(full, "band").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = placed.select("band", F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), "node").where("i <= j")
    right = placed.select("band", F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "node").where("i <= j")
    sets = rows.select("node", "shingles").dropDuplicates(["node"])
    dealt = left.unionByName(right).join(sets, "node").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side")

    def verify(batch: pa.RecordBatch, unit: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids = batch.column("node").to_numpy()
        held = [np.frombuffer(x, np.uint32) for x in batch.column("shingles").to_pylist()]
        size = np.asarray([len(x) for x in held])
        us, vs = [], []
        for i, j in cross(unit, side):
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            on = (ids[i] != ids[j]) & ((unit[i, 1] != unit[i, 2]) | (ids[i] < ids[j])) & (low >= s.similarity * high)
            for a, b in zip(i[on].tolist(), j[on].tolist(), strict=True):
                both = len(np.intersect1d(held[a], held[b], assume_unique=True))
                if both >= s.similarity * (size[a] + size[b] - both):
                    us.append(a)
                    vs.append(b)
        if not us:
            return
        node, back = np.unique(ids, return_inverse=True)
        root = forest(back[us], back[vs], len(node))
        on = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_pydict({"a": pa.array(node[on]), "b": pa.array(node[root[on]])})

    roots = components(dealt.transform(mapped, per_unit(["band", "i", "j"], verify), "a long, b long"))
    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows.select("doc_id", "node").join(named.join(lowest, "root").select("node", "class_id"), "node").select("doc_id", "class_id")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows (doc_id, text) in ascending order of ids, nulls first, ties by the text's hash, then the text: partition `part` holds a range, and
    behind its own rows (halo 0) the first row of the next range (halo 1), after the last range the very first row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("tie", F.xxhash64("text"))
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))  # as many as the texts need; ids alone would be put together
    ranges = rows.select("doc_id", "tie").repartitionByRange(wanted, "doc_id", "tie").groupBy(F.spark_partition_id().alias("p"))
    firsts = [r["first"] for r in ranges.agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("first")).collect()]  # one a range
    key = lambda doc_id, tie: (doc_id is not None, 0 if doc_id is None else doc_id, tie)
    bounds = sorted(key(r["doc_id"], r["tie"]) for r in firsts)

    @F.arrow_udf("array<int>")
    def parts(ids: pa.Array, ties: pa.Array) -> pa.Array:
        out = []
        for k in map(key, ids.to_pylist(), ties.to_pylist()):
            p = bisect_right(bounds, k) - 1
            out.append([p, (p - 1) % len(bounds)] if k == bounds[p] else [p])
        return pa.array(out, pa.list_(pa.int32()))

    placed = rows.select("*", F.posexplode(parts("doc_id", "tie")).alias("halo", "part"))
    return placed.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("part", "halo", "doc_id", "tie", "text").select("part", "halo", "doc_id", "text")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, for the text, the text whose last quarter is
    replaced by the next one's beginning, and the next text.

    Null texts count as empty; the fingerprints of texts without words are equal. A single row is its own next. Rows with one id are ordered by
    their text. Bytes that aren't UTF-8 count as U+FFFD. An empty table gives an empty table."""
    spark, s = docs.sparkSession, settings
    ship(spark)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row so far: (doc_id, text, signature)
        part = None
        for batch in batches:
            for some in slices(batch):
                rows, of = [], []
                for k, (p, halo, text) in enumerate(zip(some.column("part").to_pylist(), some.column("halo").to_pylist(), strings(some.column("text")).to_pylist(), strict=True)):
                    if before is not None and before[3] and halo and part == p:
                        continue  # further rows equal to the one behind the range
                    sig = signature(shingles(text.encode(), s.words), s)
                    if before is not None and part == p and not before[3]:
                        n = len(before[1])
                        new = (before[1][: n - n // 4] + text[: n // 4]).encode() if n // 4 else before[1].encode()
                        its = signature(shingles(new, s.words), s)
                        rows.append((n, hashlib.sha256(new).hexdigest(), hexed(before[2]), hexed(its), likeness(before[2], its), likeness(before[2], sig)))
                        of.append(before[0])
                    before, part = (some.column("doc_id")[k], text, sig, halo), p
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in of], some.column("doc_id").type), *columns], ["doc_id", *TOLD])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_order(docs, id_col, text_col).transform(mapped, local, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


TOLD = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
