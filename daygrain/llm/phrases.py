"""Phrase collocations by hierarchical pair naming.

Level one names the frequent words of each language, level two the frequent pairs of adjacent words, level three the frequent pairs of adjacent names of
level two, that is phrases of three words. A name is joined globally: each chunk of texts sends the distinct things that it holds, with their counts, to the buckets that a hash
of the thing names, packed; there counts are summed, what is frequent is named (bucket, number in it), and the names return to the chunks, whose
texts are then written in names alone. A name's row keeps the names of its left and right part, so that the counts of both sides of a cut, and
the phrases that hold another, are found by joins on names. What isn't frequent is part of no frequent phrase and has no name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrain.llm.common import give_back, mapped, ship, slices, staged, text_column
from daygrain.llm.superkmers import STEP, Words, freeze, mix, thaw

#: Bytes of texts whose distinct words are told apart at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 12 << 20
#: Bytes of text for each bucket of words, and words of text for each bucket of pairs; most tasks.
WORD_BYTES, PAIR_WORDS, MOST_PARTS = 32 << 20, 1 << 20, 20_000
#: Bits of a name for its number in its bucket, and of a chunk's number in its task.
NAME_BITS, CHUNK_BITS = 36, 13
#: Bytes of separators between words (these two) and between pieces, where no phrase goes on: . , ; : ! ? and line feed to carriage return.
BETWEEN, BREAKS = b" \t", b".,;:!?\n\v\f\r"


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_BREAK, _APART = _table(BREAKS), _table(BREAKS + BETWEEN)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of texts, A-Z in lower case; each one's text; and whether a word follows in the same piece."""
    raw = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
    apart = _APART[raw]
    edge = np.diff(apart.astype(np.int8), prepend=1, append=1)
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    n = ends - begins
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.append(0, np.cumsum(n))), pa.py_buffer(raw[~apart])])
    behind = np.cumsum([len(t) + 1 for t in texts])
    piece = np.cumsum(_BREAK[raw], dtype=np.int32)[begins] if len(begins) else begins
    return found, np.searchsorted(behind, begins, side="right"), np.append(piece[1:] == piece[:-1], False)[: len(n)]


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) >> np.uint64(32)).astype(np.int64) * buckets >> 32


def _runs(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    begins = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
    yield from ((int(of[i]), i, j) for i, j in zip(begins, [*begins[1:], len(of)], strict=True))


def _binary(lengths: np.ndarray, data: bytes) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths, dtype=np.int64))), pa.py_buffer(data)])


FIRST = "chunk long, text binary, langs array<binary>, totals array<long>, bucket int, packed binary"


def _first(docs: DataFrame, text_col: str, lang_col: str, other: str, buckets: int) -> DataFrame:
    """Per chunk: its texts in codes of words, -1 where a piece ends, and its languages with their numbers of words; and per chunk and bucket, packed: the
    distinct words there (a word, a space, its language), their counts and codes."""
    names = [c.split()[0] for c in FIRST.split(", ")]

    def told(chunk: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        found, of, goes_on = words(table.column("text").to_pylist())
        if not len(found):
            return
        lang = table.column("lang").combine_chunks().dictionary_encode()
        word = found.dictionary_encode()
        size = len(lang.dictionary)
        both, codes = np.unique(word.indices.to_numpy().astype(np.int64) * size + lang.indices.to_numpy()[of], return_inverse=True)
        w, g = np.divmod(both, size)
        n = np.bincount(codes, minlength=len(both))
        at = np.arange(len(codes)) + np.cumsum(~goes_on) - ~goes_on
        text = np.full(len(codes) + int((~goes_on).sum()), -1, np.int32)
        text[at] = codes
        totals = np.bincount(g, weights=n, minlength=size).astype(np.int64)
        yield pa.record_batch([pa.array([chunk]), pa.array([freeze(text)], pa.binary()), pa.array([lang.dictionary.to_pylist()], pa.list_(pa.binary())), pa.array([totals.tolist()], pa.list_(pa.int64())), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names)
        bucket = _buckets(Words(word.dictionary.cast(pa.binary())).hashes(), buckets)[w]
        order = np.argsort(bucket, kind="stable")
        keys = pc.binary_join_element_wise(word.dictionary.take(pa.array(w[order])).cast(pa.binary()), lang.dictionary.take(pa.array(g[order])), b" ")
        for b, i, j in _runs(bucket[order]):
            some = keys.slice(i, j - i)
            packed = freeze(pc.binary_length(some).to_numpy().astype(np.int32), b"".join(some.to_pylist()), n[order[i:j]].astype(np.int32), order[i:j].astype(np.int32))
            yield pa.record_batch([pa.array([chunk]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.list_(pa.binary())), pa.nulls(1, pa.list_(pa.int64())), pa.array([b], pa.int32()), pa.array([packed], pa.binary())], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held, size = TaskContext.get().partitionId() << CHUNK_BITS, [], 0
        for batch in batches:
            for some in slices(batch):
                if size + some.nbytes > CHUNK_BYTES and held:
                    yield from told(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
                held.append(some)
                size += some.nbytes
        if held:
            yield from told(chunk, held)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(other)).cast("binary").alias("lang"), text_column(text_col).alias("text"))
    return mapped(rows, work, FIRST)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Each bucket of rows (bucket, chunk, packed) that are sorted by bucket: its chunks and what they sent. Memory is given back after each."""
    now, chunks, held = None, [], []
    for batch in batches:
        for b, c, x in zip(batch.column("bucket").to_pylist(), batch.column("chunk").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if b != now and held:
                yield now, chunks, held
                chunks, held = [], []
                give_back()
            now = b
            chunks.append(c)
            held.append(x)
    if held:
        yield now, chunks, held


NAMED = "chunk long, packed binary, id long, f long, left_id long, right_id long, word binary"


def _returned(chunks: list[int], of: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per chunk what is told of its things, packed; `of`: each thing's chunk, ascending."""
    for c, i, j in _runs(of):
        yield _named_rows({"chunk": [chunks[c]], "packed": [freeze(*(x[i:j] for x in columns))]}, 1)


def _named_rows(told: dict, n: int) -> pa.RecordBatch:
    schema = pa.schema([("chunk", pa.int64()), ("packed", pa.binary()), ("id", pa.int64()), ("f", pa.int64()), ("left_id", pa.int64()), ("right_id", pa.int64()), ("word", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(told[f.name], f.type) if f.name in told else pa.nulls(n, f.type) for f in schema], schema=schema)


def _name_words(one: DataFrame, least: int, parts: int) -> DataFrame:
    """The names of frequent words: id, f, word (with its language); and per chunk, packed, its codes that have a name, and the names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunks, held in _by_bucket(batches):
            parts = [thaw(x, 4) for x in held]
            keys = pa.concat_arrays([_binary(np.frombuffer(p[0], np.int32), p[1]) for p in parts]).dictionary_encode()
            n, code = (np.concatenate([np.frombuffer(p[i], np.int32) for p in parts]).astype(np.int64) for i in (2, 3))
            of = np.repeat(np.arange(len(parts)), [len(p[0]) // 4 for p in parts])
            thing = keys.indices.to_numpy()
            f = np.bincount(thing, weights=n, minlength=len(keys.dictionary)).astype(np.int64)
            often = np.flatnonzero(f >= least)
            name = np.full(len(f), -1)
            name[often] = (bucket << NAME_BITS) + np.arange(len(often))
            for i in range(0, len(often), 1 << 16):
                some = often[i : i + (1 << 16)]
                yield _named_rows({"id": name[some], "f": f[some], "word": keys.dictionary.take(pa.array(some)).cast(pa.binary())}, len(some))
            stay = name[thing] >= 0
            yield from _returned(chunks, of[stay], code[stay].astype(np.int32), name[thing[stay]])

    rows = one.where("bucket is not null").select("bucket", "chunk", "packed").repartition(parts, "bucket").sortWithinPartitions("bucket")
    return mapped(rows, work, NAMED)


def _name_pairs(sent: DataFrame, least: int, parts: int, back: bool) -> DataFrame:
    """The names of frequent pairs of names: id, f, left_id, right_id; and, if they go back, per chunk, packed, its pairs that have a name, and the names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunks, held in _by_bucket(batches):
            parts = [thaw(x, 3) for x in held]
            left, right = (np.concatenate([np.cumsum(np.frombuffer(p[0], np.int64)) if i == 0 else np.frombuffer(p[1], np.int64) for p in parts]) for i in (0, 1))
            n = np.concatenate([np.frombuffer(p[2], np.int32) for p in parts]).astype(np.int64)
            of = np.repeat(np.arange(len(parts)), [len(p[2]) // 4 for p in parts])
            order = np.lexsort((right, left))
            a, b = left[order], right[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            begins = np.flatnonzero(new)
            f = np.add.reduceat(n[order], begins)
            often = np.flatnonzero(f >= least)
            name = np.full(len(f), -1)
            name[often] = (bucket << NAME_BITS) + np.arange(len(often))
            for i in range(0, len(often), 1 << 16):
                some = often[i : i + (1 << 16)]
                yield _named_rows({"id": name[some], "f": f[some], "left_id": a[begins[some]], "right_id": b[begins[some]]}, len(some))
            if back:
                mine = np.empty(len(left), np.int64)
                mine[order] = name[np.cumsum(new) - 1]
                stay = mine >= 0
                yield from _returned(chunks, of[stay], left[stay], right[stay], mine[stay])

    return mapped(sent.repartition(parts, "bucket").sortWithinPartitions("bucket"), work, NAMED)


def _send_pairs(one: DataFrame, levels: list[DataFrame], buckets: int, parts: int) -> DataFrame:
    """Per chunk and bucket, packed: the distinct pairs of adjacent names of a level, with their counts. levels: the names of words, then those of pairs if
    triples are asked for. A chunk's text meets its names in one sorted partition."""
    of_pairs = len(levels) > 1
    rows = one.where("text is not null").select("chunk", F.lit(9).alias("level"), F.col("text").alias("packed"))
    for i, names in enumerate(levels):
        rows = rows.unionByName(names.where("packed is not null").select("chunk", F.lit(i).alias("level"), "packed"))
    rows = rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "level")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, [[], []]
        for batch in batches:
            for c, level, packed in zip(batch.column("chunk").to_pylist(), batch.column("level").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                if c != now:
                    now, held = c, [[], []]
                if level < 9:
                    held[level].append(packed)
                    continue
                local, names = in_names(np.frombuffer(thaw(packed, 1)[0], np.int32), held[0])
                if of_pairs:
                    local, names = in_pairs(local, names, held[1])
                held = [[], []]
                yield from sent(c, local, names)
                give_back()

    def sent(chunk: int, local: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, both = adjacent(local, len(names))
        if not len(at):
            return
        both, n = np.unique(both, return_counts=True)
        a, b = names[both // len(names)], names[both % len(names)]
        bucket = _buckets(a.astype(np.uint64) * np.uint64(STEP) + b.astype(np.uint64), buckets)
        order = np.argsort(bucket, kind="stable")  # within a bucket pairs stay in order, which packs well
        for k, i, j in _runs(bucket[order]):
            some = order[i:j]
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([chunk]), pa.array([freeze(np.diff(a[some], prepend=0), b[some], n[some].astype(np.int32))], pa.binary())], ["bucket", "chunk", "packed"])

    return mapped(rows, work, "bucket int, chunk long, packed binary")


def adjacent(local: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where a named thing follows a named thing, and each such pair as one number."""
    at = np.flatnonzero((local[:-1] >= 0) & (local[1:] >= 0))
    return at, local[at].astype(np.int64) * size + local[at + 1]


def in_names(codes: np.ndarray, told: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's text as places in its sorted names of words (-1 for a word without one, and where a piece ends), and those names."""
    parts = [thaw(x, 2) for x in told]
    code = np.concatenate([np.frombuffer(p[0], np.int32) for p in parts] or [np.zeros(0, np.int32)])
    names = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts] or [np.zeros(0, np.int64)])
    order = np.argsort(names)
    place = np.full(int(codes.max(initial=-1)) + 2, -1, np.int32)  # the last one answers for -1
    place[code[order]] = np.arange(len(names))
    return place[codes], names[order]


def in_pairs(local: np.ndarray, words: np.ndarray, told: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """At each place of such a text the place, in its sorted names of pairs, of the pair that begins there (-1 where it has no name), and those names."""
    out = np.full(len(local), -1, np.int32)
    parts = [thaw(x, 3) for x in told]
    if not parts:
        return out, np.zeros(0, np.int64)
    left, right, names = (np.concatenate([np.frombuffer(p[i], np.int64) for p in parts]) for i in range(3))
    key = np.searchsorted(words, left) * len(words) + np.searchsorted(words, right)
    by_key, by_name = np.argsort(key), np.argsort(names)
    place = np.empty(len(names), np.int32)
    place[by_name] = np.arange(len(names))
    key, place = key[by_key], place[by_key]
    at, asked = adjacent(local, len(words))
    found = np.minimum(np.searchsorted(key, asked), len(key) - 1)
    hit = key[found] == asked
    out[at[hit]] = place[found[hit]]
    return out, names[by_name]


def _words_apart(names: DataFrame) -> DataFrame:
    """id, f, word, lang of named words: a word holds no space, so the first one ends it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [x.split(b" ", 1) for x in batch.column("word").to_pylist()]
            yield pa.record_batch([batch.column("id"), batch.column("f"), pa.array([x[0] for x in both], pa.binary()), pa.array([x[1] for x in both], pa.binary())], ["id", "f", "word", "lang"])

    return mapped(names.where("f is not null").select("id", "f", "word"), work, "id long, f long, word binary, lang binary")


def _score(a: str, left: str, right: str):
    """floor(1,000,000 a² / (l r)) in 38 digits: exact for counts up to 10^16."""
    x, y, z = (f"cast({c} as decimal(19, 0))" for c in (a, left, right))
    return F.expr(f"({x} * {x} * 1000000) div ({y} * {z})")


def candidates(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, other: str = "und") -> DataFrame:
    """All phrases of two and three words that occur `least` times or more within pieces: lang, phrase, words, a (occurrences), l and r (of the parts of
    the cut that scores least, the first such), n (words of the language), score, longest (occurrences of the most frequent candidate that holds it; null if none does).

    lang and phrase are strings. A null language counts as `other`, a null text as empty. Repeated rows count each. Bytes that aren't UTF-8 are words like others
    while counted. No columns besides the two are read; an empty table gives an empty one."""
    ship(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary"))).alias("n")).first()["n"] or 0
    buckets = max(1, -(-size // WORD_BYTES))
    one = staged(_first(docs, text_col, lang_col, other, buckets), "words")
    totals = one.where("text is not null").select(F.explode(F.arrays_zip("langs", "totals")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.totals").alias("n"))
    pair_buckets = max(1, -(-(totals.agg(F.sum("n").alias("n")).first()["n"] or 0) // PAIR_WORDS))
    parts = min(max(pair_buckets, docs.sparkSession.sparkContext.defaultParallelism), MOST_PARTS)
    names1 = staged(_name_words(one, least, min(buckets, MOST_PARTS)), "names1")
    names2 = staged(_name_pairs(_send_pairs(one, [names1], pair_buckets, parts), least, parts, True), "names2")
    triples = _name_pairs(_send_pairs(one, [names1, names2], pair_buckets, parts), least, parts, False).select("left_id", "right_id", F.col("f").alias("a"))
    word = _words_apart(names1)
    left, right = (word.select(F.col("id").alias(f"{s}_id"), F.col("f").alias(f"{s}_f"), F.col("word").alias(f"{s}_word"), *(["lang"] if s == "left" else [])) for s in ("left", "right"))
    pairs = names2.where("f is not null").select("id", "f", "left_id", "right_id").join(left, "left_id").join(right, "right_id")
    pairs = staged(pairs.select("id", "f", "lang", "left_f", "right_f", "left_word", "right_word"), "phrases2")
    p, q = (pairs.select(F.col("id").alias(f"{s}_id"), *(F.col(c).alias(f"{s}_{c}") for c in ("f", "lang", "left_f", "right_f", "left_word", "right_word"))) for s in ("left", "right"))
    triples = staged(triples.join(p, "left_id").join(q, "right_id"), "phrases3")
    # The more frequent of the candidates that hold a pair, by its name as their left or right part.
    held = triples.select(F.explode(F.array("left_id", "right_id")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("longest"))
    space = F.lit(b" ")
    whole2 = pairs.join(held, "id", "left").select(
        "lang", F.concat("left_word", space, "right_word").alias("phrase"), F.lit(2).alias("words"), F.col("f").alias("a"), F.col("left_f").alias("l"), F.col("right_f").alias("r"),
        _score("f", "left_f", "right_f").alias("score"), "longest",
    )
    cut1, cut2 = _score("a", "left_left_f", "right_f"), _score("a", "left_f", "right_right_f")
    whole3 = triples.withColumn("s1", cut1).withColumn("s2", cut2).select(
        F.col("left_lang").alias("lang"), F.concat("left_left_word", space, "left_right_word", space, "right_right_word").alias("phrase"), F.lit(3).alias("words"), "a",
        F.when(F.col("s1") <= F.col("s2"), F.col("left_left_f")).otherwise(F.col("left_f")).alias("l"), F.when(F.col("s1") <= F.col("s2"), F.col("right_f")).otherwise(F.col("right_right_f")).alias("r"),
        F.least("s1", "s2").alias("score"), F.lit(None).cast("long").alias("longest"),
    )
    return whole2.unionByName(whole3).join(totals, "lang").select(F.col("lang").cast("string"), F.col("phrase").cast("string"), "words", "a", "l", "r", "n", "score", "longest")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, most: int = 2000, share: int = 50) -> DataFrame:
    """The first `most` phrases of each language by score, occurrences and words, without those that a longer candidate holds in `share` of a hundred
    occurrences or more: lang, rank, phrase, a, l, r, n, score. Edge cases as in candidates()."""
    found = candidates(docs, text_col, lang_col, least).where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
