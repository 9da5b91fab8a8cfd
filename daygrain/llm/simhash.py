"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

Fingerprints of 64 bits are linked at `distance` or fewer differing bits. The bits are cut into parts, correlated bits
together; each part p gets a threshold t_p, -1 or more, with sum(t_p + 1) = distance + 1. Then two linked fingerprints
differ in t_p or fewer bits of some part p. Parts and thresholds are chosen by dynamic programming on candidate counts
estimated from all fingerprints. Values of a part that occur are probed with their neighbours within the threshold, and
the fingerprints of neighbouring values are compared in bounded blocks, each of which returns the edges of a forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm import jaccard
from daygrain.llm.common import give_back, held, mapped, ship, slices, staged
from daygrain.llm.graph import components, cross, forest, per_unit

BITS = 64
SEED = 42
#: Fingerprints of a part's value that are compared with each other, or with a neighbour's, in one block.
BLOCK = 1024
#: A candidate costs as much as so many probes.
CANDIDATE = 0.1


def _byte_lanes() -> np.ndarray:
    """For each byte, its bits spread over the bytes of a u64: bit i counts in byte i."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8").ravel()


_LANES = _byte_lanes()


def fingerprint(text: bytes, words: int = 4) -> int:
    """The SimHash of a text's shingles of `words` words, repeats included; 0 for a text without words."""
    w = text.lower().split()
    if not w:
        return 0
    whole = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1).tolist()
    digest = xxhash.xxh64_digest
    begins = [0, *ends[: len(w) - words]]
    h = b"".join([digest(whole[a : b - 1], SEED) for a, b in zip(begins, ends[words - 1 :], strict=True)])
    lanes = _LANES[np.frombuffer(h, np.uint8).reshape(-1, 8)[:, ::-1]]  # digests are big-endian
    n, counts = len(lanes), np.zeros((8, 8), np.int64)
    for i in range(0, n, 255):  # a byte counts to 255
        counts += lanes[i : i + 255].sum(0).view(np.uint8).reshape(8, 8)
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, words: int = 4) -> Column:
    """The fingerprint of a text as a signed long; a null text has that of an empty one."""

    @F.arrow_udf("long")
    def of(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("simhash", dict)  # nothing; what others left goes
        for chunk in chunks:
            out = [fingerprint(t, words) for some in slices(pa.record_batch([chunk], ["text"])) for t in some.column(0).to_pylist()]
            yield pa.array(np.asarray(out, np.uint64).view(np.int64), pa.int64())
        give_back()

    return of(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int  # -1: the part isn't probed

    def key(self, fp: Column) -> Column:
        """The part's bits of a fingerprint, where they are; the part's number tells parts apart."""
        return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in self.bits))))

    def masks(self) -> list[int]:
        """What turns a value into its neighbours, from 1 to `threshold` bits away."""
        return [_signed(sum(1 << b for b in some)) for r in range(1, self.threshold + 1) for some in combinations(self.bits, r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j both, over all of them. At most 4097 rows come to the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            both += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(BITS * BITS + 1)), "n": pa.array(np.append(both.ravel(), n).astype(np.int64))})

    rows = fps.select("fp").transform(mapped, local, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    got = {r["cell"]: r["n"] for r in rows}
    return got.get(BITS * BITS, 0), np.asarray([got.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Parts of nearly equal width; each grows by the bit that correlates most with those it has, begun with the bit that is left with the largest sum of correlations."""
    p = both.diagonal() / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        mine = [max(left, key=lambda b: (corr[b][left].sum(), -b))]
        left.remove(mine[0])
        while len(mine) < size:
            mine.append(max(left, key=lambda b: (corr[b][mine].sum(), -b)))
            left.remove(mine[-1])
        out.append(tuple(sorted(mine)))
    return out


def _within(p: np.ndarray, most: int) -> np.ndarray:
    """The probability that two fingerprints differ in exactly 0 to `most` of the bits, taken as independent."""
    out = np.zeros(most + 1)
    out[0] = 1.0
    for x in p:
        d = 2 * x * (1 - x)
        out = out * (1 - d) + np.append(0, out[:-1]) * d
    return out


def plan(n: int, both: np.ndarray, same: dict[tuple[int, int], int], groups: dict[int, list[tuple[int, ...]]], distance: int) -> list[Part]:
    """The parts and thresholds of least estimated cost. same: pairs with equal values, by (number of parts, part), counted over all fingerprints."""
    p, best, found = both.diagonal() / max(1, n), None, []
    for m, parts in groups.items():
        cost = np.zeros((m, distance + 2))  # by threshold + 1
        for i, bits in enumerate(parts):
            chance = np.cumsum(_within(p[list(bits)], distance))
            for t in range(distance + 1):
                probes = sum(comb(len(bits), r) for r in range(t + 1))
                pairs = same[m, i] + 0.5 * n * n * max(0.0, chance[t] - chance[0])
                cost[i, t + 1] = n * probes + CANDIDATE * pairs if probes <= 3000 else np.inf
        # least[b]: of the parts so far, with thresholds that use b of the distance + 1 units
        least, via = np.full(distance + 2, np.inf), []
        least[0] = 0
        for i in range(m):
            step = [[least[b - u] + cost[i, u] if u <= b else np.inf for u in range(distance + 2)] for b in range(distance + 2)]
            via.append([int(np.argmin(row)) for row in step])
            least = np.asarray([min(row) for row in step])
        if best is None or least[-1] < best:
            best, b, chosen = least[-1], distance + 1, []
            for i in reversed(range(m)):
                chosen.append(via[i][b])
                b -= chosen[-1]
            found = [Part(bits, u - 1) for bits, u in zip(parts, reversed(chosen), strict=True)]
    return found


def choose(fps: DataFrame, distance: int) -> list[Part]:
    n, both = bit_statistics(fps)
    groups = {m: group_bits(n, both, m) for m in range(2, distance + 2)} if distance else {1: [tuple(range(BITS))]}
    names = [(m, i) for m, parts in groups.items() for i in range(len(parts))]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), Part(groups[m][i], 0).key(F.col("fp")).alias("key")) for k, (m, i) in enumerate(names)])
    counts = fps.select(F.explode(keys).alias("x")).groupBy("x.k", "x.key").agg(F.count("*").alias("n")).groupBy("k").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()
    same = dict.fromkeys(names, 0) | {names[r["k"]]: r["pairs"] for r in counts}
    return plan(n, both, same, groups, distance)


def edges(fps: DataFrame, distance: int, parts: list[Part] | None = None, direct: bool = False) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of `fps` (distinct, column fp) at `distance` or fewer bits; an edge may stand for
    a path of such pairs. direct: only pairs at that distance, of each block those of every fingerprint with its smallest neighbour."""
    parts = [p for p in (parts or choose(fps, distance)) if p.threshold >= 0]
    placed = F.array(*[F.struct(F.lit(i).alias("part"), p.key(F.col("fp")).alias("key")) for i, p in enumerate(parts)])
    rows = fps.select("fp", F.explode(placed).alias("x")).select("fp", "x.*")
    values = staged(rows.groupBy("part", "key").agg(F.count("*").alias("n")), "values")
    units = values.where("n > 1").select("part", F.col("key").alias("k0"), F.col("key").alias("k1"), F.col("n").alias("n0"), F.col("n").alias("n1"))
    for i, p in enumerate(parts):
        if p.threshold:
            mine = values.where(F.col("part") == i)
            near = mine.select("part", F.col("key").alias("k0"), F.col("n").alias("n0"), F.explode(F.array(*[F.lit(x) for x in p.masks()])).alias("mask"))
            near = near.withColumn("k1", F.col("k0").bitwiseXOR(F.col("mask"))).where("k0 < k1").drop("mask")
            units = units.unionByName(near.join(mine.select(F.col("key").alias("k1"), F.col("n").alias("n1")), "k1").select("part", "k0", "k1", "n0", "n1"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    units = units.withColumns({"b0": blocks("n0"), "b1": blocks("n1")}).drop("n0", "n1")
    sides = units.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("k0").alias("key")), F.struct(F.lit(1).alias("side"), F.col("k1").alias("key")))).alias("s")).select("*", "s.*").drop("s")
    # A row goes to the blocks of its own number with all of the other side's; within one value, to those of which its own is the lower or upper.
    joined = rows.join(sides, ["part", "key"])
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    joined = joined.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) - 1)))
    first, second = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    joined = joined.select("part", "k0", "k1", first.alias("i"), second.alias("j"), "side", "fp").where("k0 != k1 or i <= j")
    names = ["part", "k0", "k1", "i", "j"]
    dealt = joined.repartition(*names).sortWithinPartitions(*names, "side")

    def verify(batch: pa.RecordBatch, unit: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = batch.column("fp").to_numpy()
        bits, u, v = fp.view(np.uint64), [], []
        where = np.cumsum(np.append(True, (unit[1:] != unit[:-1]).any(1)))
        for i, j in cross(unit, side):
            on = np.bitwise_count(bits[i] ^ bits[j]) <= distance
            u.append(i[on])
            v.append(j[on])
        if not u:
            return
        # A fingerprint may stand on both sides of its unit: rows with the same unit and fingerprint are one node.
        _, first, node = np.unique(np.stack([where, fp], 1), axis=0, return_index=True, return_inverse=True)
        node = node.ravel()
        u, v = node[np.concatenate(u)], node[np.concatenate(v)]
        root = np.arange(len(first))
        if direct:
            np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        else:
            root = forest(u, v, len(first))
        on = np.flatnonzero(root != np.arange(len(root)))
        if len(on):
            yield pa.RecordBatch.from_pydict({"a": pa.array(fp[first[on]]), "b": pa.array(fp[first[root[on]]])})

    return dealt.transform(mapped, per_unit(names, verify), "a long, b long")


def classes(fps: DataFrame, distance: int) -> DataFrame:
    """(fp, root) for fingerprints that link with another; fps: distinct, column fp."""
    return components(edges(fps, distance)).select(F.col("node").alias("fp"), "root")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """Per row of `docs`: doc_id, fp, component_id, the smallest id reachable over links of fingerprints.

    Texts with equal fingerprints are one node, so copies aren't paired. Null and empty texts have fingerprint 0 and link like any
    other; null ids never name a component unless it holds no other. Repeated rows stay. An empty table gives an empty table."""
    ship(docs.sparkSession)
    rows = staged(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), words).alias("fp")), "fingerprints")
    least = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = staged(classes(least.select("fp"), distance), "roots")
    named = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = staged(named.join(lowest, "root").select("fp", "component_id"), "names")
    return rows.join(names, "fp").select("doc_id", "fp", "component_id")


def marks(text: Column, words: int) -> Column:
    """struct<key, fp>: 128 bits that tell texts with different words apart, and the fingerprint. A-Z count as a-z; a null text has no words."""

    @F.arrow_udf("struct<key:binary,fp:bigint>")
    def of(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("simhash", dict)  # nothing; what others left goes
        for chunk in chunks:
            texts = [t for some in slices(pa.record_batch([chunk], ["text"])) for t in some.column(0).to_pylist()]
            keys = pa.array([xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts], pa.binary())
            fps = np.asarray([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.StructArray.from_arrays([keys, pa.array(fps, pa.int64())], ["key", "fp"])
        give_back()

    return of(F.coalesce(text, F.lit("")).cast("binary"))


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 8, exact: jaccard.Settings = jaccard.Settings()) -> DataFrame:
    """One row of each component of linked texts: that with the smallest id (nulls last), of repeated rows any one. Columns stay as they are.

    Texts are linked at the Jaccard similarity of `exact`, 0.8 of five words or more. Fingerprints of `words` words within `distance` bits, by
    the generalised pigeonhole, give the candidates, which are verified; links of fingerprints farther apart come from the exact
    join behind (see jaccard.py), so that `distance` sets what the join is left with and never the result. Texts with the same words are
    one node, so copies aren't paired; null texts and texts without words are one. An empty table gives an empty table."""
    ship(docs.sparkSession)
    extra = []
    for name in ("__row", "__marks", "__root", "__best"):
        while name in docs.columns:
            name += "_"
        extra.append(name)
    row, mark, root, best = extra
    text = F.col(text_col)
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(mark, marks(text, words)), "rows")
    first = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(row).alias("r"))).alias(best)
    each = rows.groupBy(F.col(mark)["key"].alias("key")).agg(first, F.first(F.col(mark)["fp"]).alias("fp"))
    each = staged(each.withColumn("node", F.xxhash64(f"{best}.r")), "distinct")  # one to one for a single long
    texts = rows.select(F.col(row).alias("row"), F.xxhash64(row).alias("node"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))
    # Of texts with one fingerprint each is a candidate with the first, and so are the first ones of near fingerprints.
    named = staged(each.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    equal = each.join(named, "fp").where("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    at = lambda c: named.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_"))
    near = edges(named.select("fp"), distance, direct=True).distinct().join(at("a"), "a").join(at("b"), "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    links = jaccard.links(texts, each.select(F.col(f"{best}.r").alias("row"), "node"), staged(equal.unionByName(near), "candidates"), exact)
    kept = each.join(components(links), "node", "left").groupBy(F.coalesce("root", "node").alias(root)).agg(F.min(best).alias(best))
    kept = kept.select(F.col(f"{best}.r").alias("kept"))
    return rows.join(kept, rows[row] == kept["kept"], "left_semi").select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id."""
    return linked(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
