"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairs interact, in time
linear in the features. It is fitted in numpy on a bounded sample of labelled rows (`Fit.most_rows`) and scores whole texts
in Arrow batches on the executors; nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import give_back, held, held_out, mapped, ship, slices, text_column

#: Buckets of hashed words, bins of each statistic.
WORDS, BINS = 1 << 14, 12
STATS = ("chars", "words", "word_length", "upper", "digits", "symbols", "spaces", "lines", "line_length", "distinct", "runs", "most_common", "declared", "no_declared")
SIZE = WORDS + len(STATS) * BINS


@dataclass(frozen=True)
class Fit:
    """most_rows: labelled rows that the fit uses at most, those with the smallest hash of their id."""

    most_rows: int = 12_000
    factors: int = 8
    epochs: int = 12
    rate: float = 0.1
    decay: float = 2e-5
    batch: int = 128
    seed: int = 7


class _Buckets(dict):
    """word -> bucket, up to a bound of remembered words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        b = self[word] = zlib.crc32(word) & (WORDS - 1)
        return b


def _binned(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((x - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)


def features(texts: list[bytes], declared: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sparse row a text: (where its row begins, columns, values). declared: the length that the metadata give, None if none."""
    n = len(texts)
    block = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.asarray([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(size) - size
    kind = lambda on: np.add.reduceat(on, begins, dtype=np.int64)
    upper, digits = kind((block >= 65) & (block <= 90)), kind((block >= 48) & (block <= 57))
    spaces, lines = kind(block == 32), kind(block == 10)
    lower = (block >= 97) & (block <= 122) | (block >= 128)
    symbols = size - kind(lower) - upper - digits - spaces - lines
    low = [t.lower().split() for t in texts]
    count = np.asarray([len(w) for w in low], np.int64)
    total = np.maximum(1, size - 1)
    words = np.maximum(1, count)
    buckets = held("quality", _Buckets)
    ids = np.fromiter((buckets[w] for ws in low for w in ws), np.int64, int(count.sum()))
    row = np.repeat(np.arange(n), count)
    again = np.zeros(n, np.int64)
    if len(ids) > 1:
        np.add.at(again, row[1:][(ids[1:] == ids[:-1]) & (row[1:] == row[:-1])], 1)
    pairs, tf = np.unique(row * WORDS + ids, return_counts=True)
    row_w, col_w = pairs // WORDS, pairs % WORDS
    distinct = np.bincount(row_w, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row_w, tf)
    val_w = np.log1p(tf)
    norm = np.sqrt(np.bincount(row_w, val_w**2, minlength=n))
    val_w = val_w / np.maximum(norm[row_w], 1e-12)
    told = np.asarray([-1 if d is None else max(0, d) for d in declared], float)
    stats = [
        _binned(np.log1p(total), 2, 12), _binned(np.log1p(count), 0, 10), _binned((total - spaces) / words, 2, 14), _binned(upper / total, 0, 0.6),
        _binned(digits / total, 0, 0.3), _binned(symbols / total, 0, 0.3), _binned(spaces / total, 0.05, 0.3), _binned(np.log1p(lines), 0, 6),
        _binned(np.log1p(total / lines), 2, 9), _binned(distinct / words, 0, 1), _binned(again / words, 0, 0.6), _binned(top / words, 0, 0.6),
        _binned(np.log1p(np.maximum(told, 0)), 2, 12), (told < 0).astype(np.int64),
    ]
    each = len(stats)
    row_s = np.repeat(np.arange(n), each)
    col_s = WORDS + (np.arange(each) * BINS + np.stack(stats, 1)).ravel()
    rows, cols = np.concatenate([row_w, row_s]), np.concatenate([col_w, col_s])
    values = np.concatenate([val_w, np.full(len(row_s), each**-0.5)]).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(n)), cols[order], values[order]


@dataclass(frozen=True)
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, begins: np.ndarray, cols: np.ndarray, x: np.ndarray) -> np.ndarray:
        v = self.v[cols] * x[:, None]
        s = np.add.reduceat(v, begins, axis=0)
        q = np.add.reduceat(v * v, begins, axis=0)
        return self.w0 + np.add.reduceat(self.w[cols] * x, begins) + 0.5 * (s * s - q).sum(1)

    def scores(self, texts: list[bytes], declared: list[int | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features(texts, declared)), -30, 30)).astype(np.float64))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], fit: Fit = Fit()) -> Model:
    """rows: (columns, values, label 0 or 1). By AdaGrad on the logistic loss. Without rows of both labels the score is the label's share."""
    rng = np.random.default_rng(fit.seed)
    y = np.asarray([r[2] for r in rows], float)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(rows) else 0.5
    w0, w = float(np.log(share / (1 - share))), np.zeros(SIZE, np.float32)
    v = rng.normal(0, 0.05, (SIZE, fit.factors)).astype(np.float32)
    if not len(rows) or y.min() == y.max():
        return Model(w0, w, np.zeros_like(v))
    g0, gw, gv = 1e-6, np.full(SIZE, 1e-6, np.float32), np.full_like(v, 1e-6)
    for _ in range(fit.epochs):
        for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // fit.batch)):
            cols = np.concatenate([rows[i][0] for i in some])
            x = np.concatenate([rows[i][1] for i in some])
            n = np.asarray([len(rows[i][0]) for i in some])
            begins = np.cumsum(n) - n
            vx = v[cols] * x[:, None]
            s = np.add.reduceat(vx, begins, axis=0)
            z = w0 + np.add.reduceat(w[cols] * x, begins) + 0.5 * (s * s - np.add.reduceat(vx * vx, begins, axis=0)).sum(1)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) / len(some)
            dx = np.repeat(d, n).astype(np.float32) * x
            each, back = np.unique(cols, return_inverse=True)
            dw = np.bincount(back, dx, len(each)).astype(np.float32) + fit.decay * w[each]
            part = dx[:, None] * (np.repeat(s, n, axis=0) - vx)
            dv = np.stack([np.bincount(back, part[:, f], len(each)) for f in range(fit.factors)], 1).astype(np.float32) + fit.decay * v[each]
            g0 += d.sum() ** 2
            w0 -= fit.rate * d.sum() / g0**0.5
            gw[each] += dw * dw
            w[each] -= fit.rate * dw / np.sqrt(gw[each])
            gv[each] += dv * dv
            v[each] -= fit.rate * dv / np.sqrt(gv[each])
    return Model(float(w0), w, v)


def fit(docs: DataFrame, labels: DataFrame, settings: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", length_col: str | None = "n_chars", leave: Column | None = None) -> Model:
    """A model from the labelled rows for which `leave` (over the labels' id) isn't true: at most `most_rows` of them, by the hash of the id.

    Labels other than 0 and 1 and null ids teach nothing; a document with two labels teaches both, one whose id has several texts by one of them."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    if leave is not None:
        known = known.where(~leave)
    known = known.orderBy(F.xxhash64(F.lit(settings.seed), "doc_id"), "doc_id", "label").limit(settings.most_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text"), _declared(docs, length_col).alias("declared"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                begins, cols, x = features(some.column("text").to_pylist(), some.column("declared").to_pylist())
                parts = zip(np.split(cols.astype("<i4"), begins[1:]), np.split(x.astype("<f4"), begins[1:]), strict=True)
                packed = [(c.tobytes(), v.tobytes()) for c, v in parts]
                yield pa.RecordBatch.from_pydict({"label": some.column("label"), "cols": pa.array([p[0] for p in packed], pa.binary()), "x": pa.array([p[1] for p in packed], pa.binary())})

    # most_rows bounds the broadcast; one text an id and label bounds what is collected, however often a labelled id occurs.
    one = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct("text", "declared"), F.struct(F.xxhash64("text"), "declared")).alias("x"))
    rows = one.select("label", "x.*").transform(mapped, sparse, "label int, cols binary, x binary").collect()
    rows.sort(key=lambda r: (bytes(r["cols"]), bytes(r["x"]), r["label"]))  # the order of tasks mustn't matter
    return train([(np.frombuffer(r["cols"], "<i4"), np.frombuffer(r["x"], "<f4"), r["label"]) for r in rows], settings)


def _declared(docs: DataFrame, length_col: str | None) -> Column:
    return F.col(length_col).cast("long") if length_col and length_col in docs.columns else F.lit(None).cast("long")


def score(model: Model, text: Column, declared: Column) -> Column:
    """The score of each row, 0 to 1; a null text counts as empty."""

    @F.arrow_udf("double")
    def scored(chunks: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lengths in chunks:
            out = [model.scores(some.column(0).to_pylist(), some.column(1).to_pylist()) for some in slices(pa.record_batch([texts, lengths], ["text", "declared"]))]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
        give_back()

    return scored(F.coalesce(text, F.lit("")).cast("binary"), declared)


def scored(docs: DataFrame, model: Model, out_col: str = "score", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with the column `out_col` (one of that name is replaced); rows and other columns stay as they are."""
    ship(docs.sparkSession)
    return docs.withColumn(out_col, score(model, F.col(text_col), _declared(docs, length_col)))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with a score of `threshold` or more."""
    mark = "__score"
    while mark in docs.columns:
        mark += "_"
    return scored(docs, model, mark, text_col, length_col).where(F.col(mark) >= threshold).drop(mark)


def predictions(docs: DataFrame, labels: DataFrame, settings: Fit = Fit(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: every document, by a model that learned from the labels of those not held out."""
    model = fit(docs, labels, settings, leave=held_out(F.col("doc_id"), 4, 2))
    out = scored(docs.select("doc_id", "text", "n_chars"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
