"""Embedding near-duplicates by lattice hashing.

A vector of length 1 is projected at random to 8 dimensions, twice for each table, and each projection is decoded to its
nearest point of the lattice E8; the two points and the label name a cell. A vector is stored in its own cell and probes
the cells next in distance; vectors that meet in a cell are verified by cosine in double precision. A pair is counted in the
first table, and cell, in which it meets, so that links are counted where they are found and no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from daygrain.llm.common import mapped, ship, staged
from daygrain.llm.graph import components, cross, forest, per_unit

#: Vectors of a cell that are compared with each other in one block.
BLOCK = 1024
#: Pairs of vectors that are held at a time.
SOME = 1 << 13


@dataclass(frozen=True)
class Settings:
    """cosine: of a link, at least. tables, probes: cells that a vector is stored in, and cells a table that it probes besides. scale: the
    lattice's unit, in projected length."""

    cosine: float = 0.98
    tables: int = 6
    probes: int = 4
    scale: float = 0.22
    seed: int = 3

    @property
    def keys(self) -> int:
        return 1 + self.probes


def _d8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of D8 (integers with an even sum) and the nearest with one coordinate rounded otherwise, farther by least."""
    near = np.rint(x)
    off = x - near
    order = np.argsort(-np.abs(off), axis=1)[:, :3]
    rows = np.arange(len(x))
    step = np.where(off < 0, -1.0, 1.0)

    def flipped(*which: int) -> np.ndarray:
        y = near.copy()
        for k in which:
            y[rows, order[:, k]] += step[rows, order[:, k]]
        return y

    odd = (near.sum(1).astype(np.int64) & 1).astype(bool)[:, None]
    return np.where(odd, flipped(0), near), np.where(odd, flipped(1), flipped(0, 1))


def decode(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the n nearest of four E8 points around it, doubled so that they are integers, and their squared distances; the first is the nearest point.

    E8 is D8 and D8 shifted by one half."""
    a, b = _d8(x)
    c, d = (y + 0.5 for y in _d8(x - 0.5))
    points = np.stack([a, b, c, d], 1)
    dist = ((points - x[:, None, :]) ** 2).sum(2)
    order = np.argsort(dist, axis=1, kind="stable")[:, :n]
    rows = np.arange(len(x))[:, None]
    return (points[rows, order] * 2).astype(np.int64), dist[rows, order]


def _hashed(parts: np.ndarray, salt: int) -> np.ndarray:
    """Rows of integers to 64 bits."""
    h = np.full(len(parts), (salt * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for column in parts.T.astype(np.int64).view(np.uint64):
        h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def cells(x: np.ndarray, labels: np.ndarray, s: Settings) -> np.ndarray:
    """Per vector of length 1 its cells, by table: its own, then those it probes, by falling nearness. Cells of different labels or tables differ."""
    out = np.zeros((len(x), s.tables, s.keys), np.uint64)
    dim = x.shape[1]
    rng = np.random.default_rng([s.seed, dim])
    for t in range(s.tables):
        # Two projections of a table have nothing in common where the dimension allows it; lengths are kept on average.
        basis = np.linalg.qr(rng.normal(size=(max(dim, 16), 16)))[0][:dim] if dim else np.zeros((0, 16))
        y = x @ basis * (max(dim, 16) / 64) ** 0.5 / s.scale
        p, dp = decode(y[:, :8], 3)
        q, dq = decode(y[:, 8:], 3)
        both = [(i, j) for i in range(3) for j in range(3)]
        cost = np.stack([dp[:, i] + dq[:, j] for i, j in both], 1)
        order = np.argsort(cost, axis=1, kind="stable")[:, : s.keys]
        rows = np.arange(len(x))
        for k in range(s.keys):
            i, j = order[:, k] // 3, order[:, k] % 3
            out[:, t, k] = _hashed(np.concatenate([labels[:, None], p[rows, i], q[rows, j]], 1), t)
    return out


def near(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept (see below).

    Vectors are compared within a label (one that isn't an integer by a 64-bit hash of its string); a null label or id, or a vector that is null, empty, zero, or has a null or non-finite
    component, links with nothing (component_id is the row's own id). Vectors of different lengths don't link. Equal vectors with one
    label are one node with a weight, so copies aren't paired. An id that stands at several vectors is one row for each, with the links of its
    own vector; repeated rows count as vectors of their own. Cosines below `cosine` never link; pairs at or above it are found where
    they meet in a cell. kept: the row's id is its component's smallest. An empty table gives an empty table."""
    s, spark = settings, vectors.sparkSession
    ship(spark)
    label = F.col(label_col) if isinstance(vectors.schema[label_col].dataType, IntegralType) else F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col).cast("string")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", number) & F.exists("v", lambda x: x != 0)
    rows = staged(rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("v", F.when(F.col("sound"), F.transform("v", lambda x: x + 0.0))), "vectors")
    # A class has a number of its own: one vec_id may stand at several vectors.
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").to_pylist()
            labels = batch.column("label").to_numpy()
            dims = np.asarray([len(x) for x in v], int)
            keys = np.zeros((len(v), s.tables * s.keys), np.uint64)
            unit: list = [b""] * len(v)
            for dim in np.unique(dims).tolist():
                on = np.flatnonzero(dims == dim)
                x = np.asarray([v[i] for i in on.tolist()], np.float64)
                x /= np.abs(x).max(1, keepdims=True)  # else the squares of very large or small ones are lost
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                keys[on] = cells(x, labels[on] * 1_000_003 + dim, s).reshape(len(on), -1)
                for i, u in zip(on.tolist(), x, strict=True):
                    unit[i] = u.tobytes()
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * s.tables * s.keys, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("weight"), pa.array(unit, pa.binary()), lists], ["id", "weight", "unit", "cells"])

    nodes = staged(classes.drop("least").transform(mapped, hashed, "id long, weight long, unit binary, cells array<long>"), "nodes")
    met = nodes.select("id", F.posexplode("cells").alias("k", "cell")).select("id", "cell", (F.col("k") % s.keys == 0).alias("home"))
    # A vector that probes a cell it is stored in, or one cell twice, is there once.
    met = met.groupBy("cell", "id").agg(F.max("home").alias("home"))
    full = met.groupBy("cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("n_home")).where("n > 1 and n_home > 0")
    full = full.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = met.join(full, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Side 0: stored vectors; side 1: all that are stored or probe. Each block of the one meets each block of the other.
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = placed.where("home").select("cell", F.col("own").alias("i"), F.explode(every).alias("j"), F.lit(0).alias("side"), "home", "id")
    right = placed.select("cell", F.explode(every).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), "home", "id")
    dealt = left.unionByName(right).join(nodes, "id").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")

    def verify(batch: pa.RecordBatch, unit: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, weight = batch.column("id").to_numpy(), batch.column("weight").to_numpy()
        home = batch.column("home").to_numpy(zero_copy_only=False)
        raw = batch.column("unit").to_pylist()
        keys = np.asarray(batch.column("cells").flatten()).reshape(len(ids), s.tables, s.keys)
        cell = unit[:, 0]
        dim = np.asarray([len(x) for x in raw])
        x = np.zeros((len(ids), int(dim.max()) // 8))
        for d in np.unique(dim).tolist():
            on = np.flatnonzero(dim == d)
            x[on, : d // 8] = np.frombuffer(b"".join([raw[i] for i in on.tolist()])).reshape(len(on), -1)
        us, vs = [], []
        for i, j in cross(unit, side):
            on = (ids[i] != ids[j]) & (dim[i] == dim[j]) & (~home[j] | (ids[i] < ids[j]))
            i, j = i[on], j[on]
            for at in range(0, len(i), SOME):
                a, b = i[at : at + SOME], j[at : at + SOME]
                on = np.einsum("nd,nd->n", x[a], x[b]) >= s.cosine
                us.append(a[on])
                vs.append(b[on])
        u, v = np.concatenate(us) if us else np.zeros(0, int), np.concatenate(vs) if vs else np.zeros(0, int)
        first = np.concatenate([_first(keys[u[k : k + SOME]], keys[v[k : k + SOME]], ids[u[k : k + SOME]], ids[v[k : k + SOME]]) for k in range(0, len(u), SOME)]) if len(u) else np.zeros(0, np.int64)
        on = first == cell[u]
        u, v = u[on], v[on]
        if not len(u):
            return
        node, back = np.unique(ids, return_inverse=True)
        links = np.bincount(back[u], weight[v], len(node)) + np.bincount(back[v], weight[u], len(node))
        root = forest(back[u], back[v], len(node))
        on = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_pydict({"id": pa.array(node[on]), "links": pa.array(links[on].astype(np.int64)), "to": pa.array(node[root[on]])})

    found = staged(dealt.transform(mapped, per_unit(["cell", "i", "j"], verify), "id long, links long, to long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "id")
    told = classes.join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1).join(lowest, "root")
    out = rows.where("sound").join(told.select("label", "v", "n_links", "component_id"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _first(a: np.ndarray, b: np.ndarray, ida: np.ndarray, idb: np.ndarray) -> np.ndarray:
    """The cell in which each pair meets first: by table; in a table the shared own cell, else the own cell of the smaller id that the other probes, else the other's."""
    swap = (ida > idb)[:, None, None]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out, open_ = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for t in range(a.shape[1]):
        at, bt = a[:, t], b[:, t]
        same, by_b, by_a = at[:, 0] == bt[:, 0], (bt[:, 1:] == at[:, :1]).any(1), (at[:, 1:] == bt[:, :1]).any(1)
        cell = np.where(same | by_b, at[:, 0], bt[:, 0])
        on = open_ & (same | by_a | by_b)
        out[on] = cell[on]
        open_ &= ~on
    return out
