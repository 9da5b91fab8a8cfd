"""Substring dedup: windows of words that also begin in a document with a smaller id, by super-k-mers.

A window's minimiser is the least of its word trigrams in an order of hashes. Consecutive windows of a document that share a minimiser travel
as one packed string, their words joined by spaces, to the bucket that the minimiser names, so that equal windows meet whatever stands around
them. There distinct strings are told apart, and their windows are sorted and counted exactly.

Against hot keys: equal strings of a chunk of texts travel once, with the places where they occur; in a bucket an occurrence in any document but the
string's first is settled at once (that document has all its windows), so copies need no memory; and trigrams that occur very often come last in the order,
so that a line that a third of all documents hold hands its windows to the rarer trigrams around it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from daygrain.llm.common import give_back, mapped, ship, slices, staged, text_column

#: Bytes of packed strings that a task gathers before it deals them to buckets, and that a bucket puts together at a time.
CHUNK_BYTES, FOLD_BYTES = 16 << 20, 12 << 20
#: Bytes of words that are hashed at a time.
HASHED = 1 << 20
#: Cells in which trigrams are counted, and cells that travel as one row.
CELLS, BLOCK = 1 << 22, 1 << 12
#: Buckets that a task takes one after the other, and most tasks.
TOGETHER, MOST_PARTS = 4, 20_000
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
TOP = np.uint64(1 << 63)


@dataclass(frozen=True)
class Settings:
    """window: words of a window; gram: words of a minimiser; bucket: packed strings that a bucket is meant to hold; hot: occurrences from which a gram comes last.

    None changes a result. hot grows with the corpus where the cells fill: four times a cell's mean at least."""

    window: int = 13
    gram: int = 3
    bucket: int = 1 << 16
    hot: int = 1 << 18

    def __post_init__(self):
        object.__setattr__(self, "gram", min(self.gram, self.window))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits depend on all of them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return np.append(one, np.cumprod(np.full(n, BASE))), np.append(one, np.cumprod(np.full(n, inverse)))


class Words:
    """The words of texts, one after the other.

    data: their bytes, a space behind each; start, length: of each word in it; doc: its text; first: each text's first word (and behind the last)."""

    def __init__(self, texts: pa.Array):
        n = len(texts)
        texts = pc.fill_null(texts, b"")
        raw = np.frombuffer(b" ".join([*texts.to_pylist(), b""]), np.uint8)  # a space behind each
        apart = (raw == 32) | ((raw >= 9) & (raw <= 13))
        behind = np.append(True, apart)[:-1]
        begins = np.flatnonzero(~apart & behind)
        self.length = np.flatnonzero(apart & ~behind) - begins
        self.data = np.where(apart, np.uint8(32), raw)[~(apart & behind)]
        self.start = np.cumsum(self.length + 1) - (self.length + 1)
        at = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1) if n else np.zeros(0, np.int64)  # behind each text and its space
        self.first = np.append(0, np.searchsorted(begins, at))
        self.doc = np.repeat(np.arange(n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes. It only chooses buckets and an order to sort in."""
        out = np.zeros(len(self.start), np.uint64)
        ends = self.start + self.length
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(ends, self.start[i] + HASHED)))
            a = int(self.start[i])
            some = self.data[a : int(ends[j - 1])].astype(np.uint64) + np.uint64(1)
            up, down = _known_powers(len(some))
            sums = np.append(np.uint64(0), np.cumsum(some * up[: len(some)]))
            out[i:j] = (sums[ends[i:j] - a] - sums[self.start[i:j] - a]) * down[self.start[i:j] - a]
            i = j
        return mix(out)


_held_powers = _powers(HASHED)


def _known_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _held_powers if n <= HASHED else _powers(n)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each word on; meaningless where fewer follow."""
    out, c = h.copy(), STEP
    for j in range(1, k):
        out[: len(h) - j] += h[j:] * np.uint64(c)
        c = c * STEP % (1 << 64)
    return mix(out)


def least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` numbers from each on; meaningless where fewer follow."""
    out, done = x.copy(), 1
    while done < width:
        step = min(done, width - done)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def _cells(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(42)).astype(np.int64)  # the upper 22 bits


class Packed:
    """The super-k-mers of texts: words from `begin` on, `n` windows, in the bucket of `minimiser`."""

    def __init__(self, words: Words, settings: Settings, hot: np.ndarray | None):
        k, w = settings.window, settings.gram
        last = len(words.start) - k + 1  # windows begin before it
        if last <= 0:
            self.begin = self.n = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.uint64)
            return
        g = grams(words.hashes(), w)
        order = g >> np.uint64(1)
        if hot is not None:
            order |= np.where(hot[_cells(g)], TOP, np.uint64(0))
        m = least_ahead(order, k - w + 1)[:last]
        at = np.flatnonzero(words.doc[:last] == words.doc[k - 1 :])
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (m[at[1:]] != m[at[:-1]])
        begins = np.flatnonzero(new)
        self.begin, self.n, self.minimiser = at[begins], np.diff(np.append(begins, len(at))), m[at[begins]]

    def strings(self, words: Words, window: int) -> pa.Array:
        """Each super-k-mer's words, joined by spaces."""
        last = self.begin + self.n + window - 2
        return _cut(words.data, words.start[self.begin], words.start[last] + words.length[last])


def _cut(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of data, which may overlap, as an array of their own."""
    n = ends - begins
    to = np.cumsum(n)
    at = np.arange(to[-1] if len(to) else 0) + np.repeat(begins - (to - n), n)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, to).astype(np.int64)), pa.py_buffer(data[at])])


def freeze(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.compress(struct.pack(f"<{len(raw)}Q", *map(len, raw)) + b"".join(raw), 3)


def thaw(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.decompress(data)
    lengths = struct.unpack_from(f"<{n}Q", raw)
    ends = 8 * n + np.cumsum(lengths)
    return [raw[e - k : e] for e, k in zip(ends.tolist(), lengths, strict=True)]


def _ids_out(ids: np.ndarray) -> bytes:
    return ids.tobytes() if ids.dtype == np.int64 else b"\0".join(x.encode().replace(b"\x01", b"\x01\x02").replace(b"\0", b"\x01\x03") for x in ids)


def _ids_in(data: bytes, textual: bool) -> np.ndarray:
    if not textual:
        return np.frombuffer(data, np.int64)
    return np.array([x.replace(b"\x01\x03", b"\0").replace(b"\x01\x02", b"\x01").decode() for x in data.split(b"\0")], object)


def _key(docs: DataFrame, id_col: str) -> tuple[Column, bool]:
    """An id as an integer, or as a string where it isn't one; a null is behind all others."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)), False
    return F.coalesce(F.concat(F.lit("0"), F.col(id_col).cast("string")), F.lit("1")), True


def _hot(rows: DataFrame, settings: Settings) -> tuple[int, np.ndarray | None]:
    """The number of words, and which cells of grams are hot (None: none is). The table of cells has one size at every size of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in batches:
            for some in slices(batch):
                told, n = np.unique(_cells(grams(Words(some.column("text")).hashes(), settings.gram)), return_counts=True)
                cells[told] += n
        for i in range(0, CELLS, BLOCK):
            if cells[i : i + BLOCK].any():
                yield pa.record_batch([pa.array([i // BLOCK], pa.int32()), pa.array([freeze(cells[i : i + BLOCK])], pa.binary())], ["block", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                found = np.frombuffer(thaw(data, 1)[0], np.int64)
                sums[b] = sums[b] + found if b in sums else found
        for b, x in sums.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([freeze(x)], pa.binary()), pa.array([int(x.sum())]), pa.array([int(x.max())])], ["block", "cells", "n", "most"])

    parts = mapped(rows, count, "block int, cells binary").repartition(16, "block")
    sums = staged(mapped(parts, merge, "block int, cells binary, n long, most long"), "grams")
    words = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bound = max(settings.hot, 4 * words // CELLS)
    hot = np.zeros(CELLS, bool)
    for r in sums.where(F.col("most") >= bound).toLocalIterator():  # at most CELLS / BLOCK rows
        hot[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(thaw(bytes(r["cells"]), 1)[0], np.int64) >= bound
    return words, hot if hot.any() else None


def _dealt(rows: DataFrame, settings: Settings, buckets: int, hot: np.ndarray | None, textual: bool) -> DataFrame:
    """Per chunk of texts and bucket: its distinct packed strings and where they occur, frozen."""
    sent = rows.sparkSession.sparkContext.broadcast(None if hot is None else np.packbits(hot))  # half a megabyte

    def deal(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        texts, minimisers, docs, starts, ns, ids, checks = ([x[i] for x in held] for i in range(7))
        told = pa.concat_arrays(texts).dictionary_encode()
        strings, code = told.dictionary, told.indices.to_numpy().astype(np.int64)
        shift = np.cumsum([0, *(len(x) for x in ids)])
        doc = np.concatenate([d + s for d, s in zip(docs, shift[:-1], strict=True)])
        start, n, ids, checks = np.concatenate(starts), np.concatenate(ns), np.concatenate(ids), np.concatenate(checks)
        of = np.zeros(len(strings), np.int64)
        of[code] = (mix(np.concatenate(minimisers)) >> np.uint64(32)).astype(np.int64) * buckets >> 32
        place = np.empty(len(strings), np.int64)
        by_bucket = np.argsort(of, kind="stable")
        place[by_bucket] = np.arange(len(strings))
        order = np.lexsort((doc, place[code]))  # occurrences by bucket and string
        strings, of, code, doc, start, n = strings.take(pa.array(by_bucket)), of[by_bucket], place[code][order], doc[order], start[order], n[order]
        for b in np.unique(of).tolist():
            i, j = np.searchsorted(of, [b, b + 1])
            x, y = np.searchsorted(code, [i, j])
            some, local = np.unique(doc[x:y], return_inverse=True)
            part = strings.slice(i, j - i)
            lengths = pc.binary_length(part).to_numpy().astype(np.uint32)
            text = b"".join(part.to_pylist())
            counts = np.bincount(code[x:y] - i, minlength=j - i).astype(np.uint32)
            data = freeze(lengths, text, counts, local.astype(np.uint32), start[x:y].astype(np.uint32), n[x:y].astype(np.uint32), _ids_out(ids[some]), checks[some])
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([data], pa.binary())], ["bucket", "packed"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None if sent.value is None else np.unpackbits(sent.value).astype(bool)
        held, size = [], 0
        for batch in batches:
            for some in slices(batch):
                words = Words(some.column("text"))
                found = Packed(words, settings, marks)
                if not len(found.begin):
                    continue
                texts = found.strings(words, settings.window)
                doc = words.doc[found.begin]
                ids = some.column("key").to_numpy(zero_copy_only=False)
                held.append((texts, found.minimiser, doc, found.begin - words.first[doc], found.n, ids if textual else ids.astype(np.int64), some.column("check").to_numpy()))
                size += texts.nbytes
                if size >= CHUNK_BYTES:
                    yield from deal(held)
                    held, size = [], 0
        yield from deal(held)

    return mapped(rows, work, "bucket int, packed binary")


class Bucket:
    """What a bucket holds: distinct packed strings, the least id of each, and the occurrences in documents of that id."""

    def __init__(self, settings: Settings, textual: bool):
        self.k, self.textual = settings.window, textual
        self.strings = pa.array([], pa.large_binary())
        self.code, self.start, self.n = (np.zeros(0, np.int64) for _ in range(3))
        self.check, self.id = np.zeros(0, np.int64), np.zeros(0, object if textual else np.int64)

    def add(self, blobs: list[bytes]) -> tuple[np.ndarray, ...]:
        """Takes strings up; returns the occurrences that this settles (id, check, start, n): all their windows begin in an earlier document."""
        strings, code, shift = [self.strings], [self.code], len(self.strings)
        rest = [[self.start], [self.n], [self.id], [self.check]]
        for blob in blobs:
            lengths, text, counts, doc, start, n, ids, checks = thaw(blob, 8)
            lengths = np.frombuffer(lengths, np.uint32).astype(np.int64)
            strings.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(text)]))
            code.append(np.repeat(np.arange(len(lengths)), np.frombuffer(counts, np.uint32)) + shift)
            shift += len(lengths)
            doc = np.frombuffer(doc, np.uint32)
            for to, x in zip(rest, (np.frombuffer(start, np.uint32).astype(np.int64), np.frombuffer(n, np.uint32).astype(np.int64), _ids_in(ids, self.textual)[doc], np.frombuffer(checks, np.int64)[doc]), strict=True):
                to.append(x)
        told = pa.concat_arrays(strings).dictionary_encode()
        self.strings = told.dictionary
        code = told.indices.to_numpy().astype(np.int64)[np.concatenate(code)]
        start, n, ids, check = (np.concatenate(x) for x in rest)
        known, rank = np.unique(ids, return_inverse=True)
        least = np.full(len(self.strings), len(known))
        np.minimum.at(least, code, rank)
        later = rank > least[code]
        stay = ~later
        self.code, self.start, self.n, self.id, self.check = code[stay], start[stay], n[stay], ids[stay], check[stay]
        return ids[later], check[later], start[later], n[later]

    def end(self) -> tuple[np.ndarray, ...]:
        """The runs of windows of the occurrences that are left which begin in an earlier document, too (id, check, start, n)."""
        words = Words(self.strings.cast(pa.binary()))
        known, rank = np.unique(self.id, return_inverse=True)
        least = np.zeros(len(self.strings), np.int64)
        least[self.code] = rank
        last = len(words.start) - self.k + 1
        at = np.flatnonzero(words.doc[:last] == words.doc[self.k - 1 :])
        owner = words.doc[at]
        first = np.searchsorted(owner, np.arange(len(self.strings)))
        h = grams(words.hashes(), self.k)[at]
        order = np.argsort(h, kind="stable")
        h = h[order]
        again = np.zeros(len(at), bool)
        again[1:] = h[1:] == h[:-1]
        twice = again.copy()
        twice[:-1] |= again[1:]
        some = order[twice]  # windows that aren't alone with their hash; their words decide
        early = np.zeros(len(at), bool)
        if len(some):
            ends = at[some] + self.k - 1
            same = _cut(words.data, words.start[at[some]], words.start[ends] + words.length[ends]).dictionary_encode().indices.to_numpy().astype(np.int64)
            lowest = np.full(same.max() + 1, len(known))
            np.minimum.at(lowest, same, least[owner[some]])
            early[some] = lowest[same] < least[owner[some]]
        # Runs of such windows by string, then for each occurrence of it.
        hit = np.flatnonzero(early)
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])
        begins = np.flatnonzero(new)
        begin, n = hit[begins], np.diff(np.append(begins, len(hit)))
        of = owner[begin]
        lo, hi = np.searchsorted(of, self.code), np.searchsorted(of, self.code, side="right")
        occurrence = np.repeat(np.arange(len(self.code)), hi - lo)
        run = np.arange(len(occurrence)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)
        return self.id[occurrence], self.check[occurrence], self.start[occurrence] + begin[run] - first[of[run]], n[run]


def _runs(dealt: DataFrame, settings: Settings, parts: int, textual: bool) -> DataFrame:
    """Runs of windows that begin in a document with a smaller id, too: key, check, start (words of the document before), n (windows)."""
    kind = pa.string() if textual else pa.int64()

    def rows(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        if len(found[0]):
            yield pa.record_batch([pa.array(found[0], kind), *map(pa.array, found[1:])], ["key", "check", "start", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket, held, size = None, None, [], 0
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed"), strict=True):
                if b != now:
                    if bucket is not None:
                        yield from rows(bucket.add(held))
                        yield from rows(bucket.end())
                        bucket = None
                        give_back()
                    now, bucket, held, size = b, Bucket(settings, textual), [], 0
                blob = blob.as_py()
                held.append(blob)
                size += zstandard.frame_content_size(blob)
                if size >= FOLD_BYTES:
                    yield from rows(bucket.add(held))
                    held, size = [], 0
        if bucket is not None:
            yield from rows(bucket.add(held))
            yield from rows(bucket.end())

    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return mapped(dealt, work, f"key {'string' if textual else 'long'}, check long, start long, n long")


def _marked(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """Per row: doc_id, text (bytes), runs (null where there is none)."""
    ship(docs.sparkSession)
    key, textual = _key(docs, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text_column(text_col).alias("text")).withColumn("check", F.xxhash64("text"))
    words, hot = _hot(rows, settings)
    buckets = max(1, -(-2 * words // ((settings.window - settings.gram + 2) * settings.bucket)))
    dealt = _dealt(rows.select("key", "check", "text"), settings, buckets, hot, textual)
    runs = staged(_runs(dealt, settings, min(-(-buckets // TOGETHER), MOST_PARTS), textual), "runs")
    runs = runs.groupBy("key", "check").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # no more than a document has windows
    return rows.join(runs, ["key", "check"], "left").select("doc_id", "text", "runs")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, text (bytes: the words that stay, joined by one space), n_words, n_removed, spans (array of (start, end): words that go).

    Words are runs of bytes other than the space and the bytes 9 to 13; a word goes if a window that covers it begins in a document with a smaller id, too.
    A null text has no words. A null id counts as greater than all others; ids that aren't integers are compared as strings. Rows with one id are no
    reason to cut each other, whether their texts are equal or not. Bytes that aren't UTF-8 stay as they are. Columns besides the two aren't read;
    an empty table gives an empty one."""
    kind = docs.schema[id_col].dataType.simpleString()
    window = settings.window
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                words, runs = Words(some.column("text")), some.column("runs")
                flat, each = runs.flatten(), pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
                begin = flat.field("start").to_numpy() + np.repeat(words.first[:-1], each)
                steps = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(steps, begin, 1)
                np.add.at(steps, begin + flat.field("n").to_numpy() + window - 1, -1)
                gone = np.cumsum(steps[:-1]) > 0
                n_words = np.diff(words.first)
                removed = np.diff(np.append(0, np.cumsum(gone))[words.first])
                kept = words.data[np.repeat(~gone, words.length + 1)]
                ends = np.append(0, np.cumsum(np.where(gone, 0, words.length + 1)))[words.first]
                begins, ends = ends[:-1], np.maximum(ends[1:] - 1, ends[:-1])  # without the space behind the last word
                edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0))
                edge = np.unique(np.concatenate([edge, words.first[1:-1][(words.first[1:-1] < len(gone))]])) if len(gone) else edge
                heads = edge[gone[edge]]
                tails = np.append(edge, len(gone))[np.searchsorted(edge, heads, side="right")]
                offsets = np.searchsorted(heads, words.first).astype(np.int32)
                base = words.first[words.doc[heads]]
                spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(heads - base), pa.array(tails - base)], ["start", "end"]))
                yield pa.record_batch([some.column("doc_id"), _cut(kept, begins, ends).cast(pa.binary()), pa.array(n_words), pa.array(removed), spans.cast(span)], ["doc_id", "text", "n_words", "n_removed", "spans"])

    return mapped(_marked(docs, id_col, text_col, settings), work, f"doc_id {kind}, text binary, n_words long, n_removed long, spans array<struct<start:long,end:long>>")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the words that stay. Edge cases as in dedupe()."""
    return dedupe(docs, id_col, text_col, settings).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
