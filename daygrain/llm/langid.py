"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed character n-grams, of length 1. Each language has several centroids, clustered from a
bounded sample of its rows; a text gets the language of the centroid with the largest cosine, and is rejected where it lies
farther from it than nearly all of the language's own rows. Document frequencies cover all rows that may teach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.llm.common import give_back, held_out, mapped, ship, slices, staged, text_column

BUCKETS = 1 << 12
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """most_rows: rows of a language that its centroids are clustered from, about. far: share of a language's own rows that lie farther than its bound."""

    most_rows: int = 500
    centroids: int = 4
    rounds: int = 10
    far: float = 0.002
    seed: int = 11


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(texts: list[str]) -> Iterator[np.ndarray]:
    """Per text the counts of its 1-, 2- and 3-grams of letters, in buckets. Case doesn't matter; a run of other ASCII characters is one space."""
    low = [t.lower() for t in texts]
    whole = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.asarray([len(t) + 1 for t in low], np.int64)
    space = (whole < 128) & ((whole < 97) | (whole > 122))
    keep = np.ones(len(whole), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[np.cumsum(sizes) - 1] = True  # a text's end stays, that grams don't cross it
    ends = np.cumsum(keep)[np.cumsum(sizes) - 1].tolist()
    chars = np.where(space, np.uint32(32), whole)[keep]
    one = chars * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (chars[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (chars[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    one, two, three = ((g >> shift).astype(np.int32) for g in (one, two, three))
    at = 0
    for end in ends:
        n = end - at - 1
        c = np.bincount(one[at : at + n], minlength=BUCKETS)
        if n > 1:
            c += np.bincount(two[at : at + n - 1], minlength=BUCKETS)
        if n > 2:
            c += np.bincount(three[at : at + n - 2], minlength=BUCKETS)
        yield c
        at = end


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    of: np.ndarray  # the language's place, per centroid
    centroids: np.ndarray  # a row each, of length 1
    idf: np.ndarray
    bound: np.ndarray  # the smallest cosine that isn't rejected, per language

    def vectors(self, texts: list[str]) -> np.ndarray:
        return _vectors(texts, self.idf)

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text (place of the language, cosine, rejected)."""
        if not len(self.langs):
            return np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool)
        best, cosine = np.zeros(len(texts), int), np.zeros(len(texts))
        for i in range(0, len(texts), 256):
            c = self.vectors(texts[i : i + 256]) @ self.centroids.T
            k = c.argmax(1)
            best[i : i + 256], cosine[i : i + 256] = self.of[k], c[np.arange(len(k)), k]
        return best, np.clip(cosine, 0, 1), cosine < self.bound[best]


def _vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, c in zip(out, counts(texts), strict=True):
        np.log1p(c, out=row)
    out *= idf
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out


def cluster(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; fewer centroids where there are fewer rows."""
    k = min(k, len(x))
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(1)
        centre = np.stack([x[near == i].mean(0) if (near == i).any() else centre[i] for i in range(k)])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def fit(docs: DataFrame, settings: Fit = Fit(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", leave: Column | None = None) -> Model:
    """A model from rows with a language and a letter in the text for which `leave` isn't true. A language is clustered from the `most_rows` rows of it whose ids
    and texts have the smallest hashes; rows that are equal in both are one. Languages come to the driver, with as many vectors each."""
    ship(docs.sparkSession)
    known = docs if leave is None else docs.where(~leave)
    known = known.select(F.col(id_col).cast("string").alias("doc_id"), text_column(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null")
    known = known.select("lang", "text", F.xxhash64(F.lit(settings.seed), "doc_id", "text").alias("place"))
    most = settings.most_rows

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, first = np.zeros(BUCKETS, np.int64), 0, {}
        for batch in batches:
            for some in slices(batch):
                texts = [t.decode(errors="replace") for t in some.column("text").to_pylist()]
                for c in counts(texts):
                    df += c > 0
                    n += 1
                lettered = np.asarray([has_letter(t) for t in texts], bool)
                place, lang = some.column("place").to_numpy(), some.column("lang").dictionary_encode()
                of = lang.indices.to_numpy()
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    mine = np.unique(np.append(first.get(name, np.zeros(0, np.int64)), place[lettered & (of == i)]))
                    first[name] = mine[:most]
        at = np.append(np.flatnonzero(df), BUCKETS)
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(df[at[:-1]], n)), pa.nulls(len(at), pa.string()), none], ["bucket", "n", "lang", "place"])
        for name, places in first.items():
            none = pa.nulls(len(places), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([name] * len(places), pa.string()), pa.array(places)], ["bucket", "n", "lang", "place"])

    told = staged(known.transform(mapped, frequencies, "bucket long, n long, lang string, place long"), "frequencies")
    df, total = np.zeros(BUCKETS), 0
    for r in told.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] == BUCKETS:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 0.05
    # At most `most_rows` places of a language and task are ranked; the last of the first ones bounds the sample.
    order = Window.partitionBy("lang").orderBy("place")
    places = told.where("lang is not null").select("lang", "place").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    last = {r["lang"]: r["place"] for r in places.groupBy("lang").agg(F.max("place").alias("place")).collect()}
    if not last:
        return Model((), np.zeros(0, int), np.zeros((0, BUCKETS), np.float32), idf, np.zeros(0))
    sample = known.where(F.col("place") <= F.element_at(F.create_map(*[F.lit(x) for pair in last.items() for x in pair]), F.col("lang")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()  # equal rows of a task are one
        for batch in batches:
            for some in slices(batch):
                keys = list(zip(some.column("lang").to_pylist(), some.column("place").to_pylist(), strict=True))
                new = [i for i, k in enumerate(keys) if k not in seen and (seen.add(k) or True)]
                some = some.take(pa.array(new, pa.int64()))
                texts = [t.decode(errors="replace") for t in some.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"lang": some.column("lang"), "place": some.column("place"), "x": pa.array([x.astype("<f2").tobytes() if has_letter(t) else None for t, x in zip(texts, _vectors(texts, idf), strict=True)], pa.binary())})

    rows = sample.transform(mapped, vectors, "lang string, place long, x binary").where("x is not null").groupBy("lang", "place").agg(F.first("x").alias("x")).collect()  # most_rows a language, of 8 kB
    sizes = sorted(last.items())
    rng, langs, of, centres, bound = np.random.default_rng(settings.seed), [], [], [], []
    for lang, _ in sizes:
        mine = sorted(bytes(r["x"]) for r in rows if r["lang"] == lang)
        if not mine:
            continue
        x = np.frombuffer(b"".join(mine), "<f2").reshape(-1, BUCKETS).astype(np.float32)
        c = cluster(x, settings.centroids, settings.rounds, rng)
        of += [len(langs)] * len(c)
        langs.append(lang)
        centres.append(c)
        bound.append(np.quantile((x @ c.T).max(1), settings.far))
    return Model(tuple(langs), np.asarray(of, int), np.concatenate(centres) if centres else np.zeros((0, BUCKETS), np.float32), idf, np.asarray(bound))


def identify(model: Model, text: Column) -> Column:
    """struct<lang, cosine, rejected>: the nearest language, `und` for a text that is null or without a letter (cosine 0, rejected). Bytes that
    aren't UTF-8 count as U+FFFD."""

    @F.arrow_udf("struct<lang:string,cosine:double,rejected:boolean>")
    def told(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in chunks:
            langs, cosines, far = [], [], []
            for some in slices(pa.record_batch([chunk], ["text"])):
                texts = [t.decode(errors="replace") for t in some.column(0).to_pylist()]
                best, cosine, rejected = model.nearest(texts)
                letter = np.asarray([has_letter(t) for t in texts], bool) & (len(model.langs) > 0)
                langs += [model.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                cosines.append(np.where(letter, cosine, 0.0))
                far.append(rejected | ~letter)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate(cosines) if cosines else [], pa.float64()), pa.array(np.concatenate(far) if far else [], pa.bool_())], ["lang", "cosine", "rejected"]
            )
        give_back()

    return told(F.coalesce(text, F.lit("")).cast("binary"))


def with_language(docs: DataFrame, model: Model, out_col: str = "language", text_col: str = "text") -> DataFrame:
    """`docs` with struct<lang, cosine, rejected> in `out_col` (replaced if there); rows and other columns stay as they are. A caller that
    wants rejection takes `und` where `rejected` is true."""
    ship(docs.sparkSession)
    return docs.withColumn(out_col, identify(model, F.col(text_col)))


def predictions(docs: DataFrame, settings: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: every document, by a model that learned from those not held out."""
    model = fit(docs, settings, leave=held_out(F.col("doc_id"), 3, 1))
    out = with_language(docs.select("doc_id", "text"), model, "l")
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.cosine").alias("score"), F.col("l.rejected").alias("rejected"))
