"""Alignment of the tokens of two public tokenizers over the same bytes, and the tokens that stand for each other in the corpus.

A is a byte-level vocabulary (tokenizers), B a vocabulary of pieces (sentencepiece), which itself puts a space before a text; A reads
the text behind a space. Neither has a token that reaches over a single space or line feed between two other characters, so that
a text falls into units there, both tokenizers end a token at each unit's end, and equal units align alike. The distinct units of an
Arrow batch are tokenized once; DuckDB, in the task, lays their tokens out as tables of byte intervals and finds

* by ASOF joins, the token of the other side that holds the last byte of each token; where both end there, both are linked;
* by window sums of those ends, the group that a token belongs to;
* by a range join, all tokens of both sides that overlap.

Spark merges the partial counts of linked pairs. Of two linked tokens the bytes of one end the bytes of the other, so a
pair is a token and one of its suffixes: there are at most as many pairs as the tokens of both vocabularies have bytes, half a
million here, whatever the corpus. Only this table is sent to all tasks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrain.llm import tokens
from daygrain.llm.common import held, mapped, ship, slices, staged, strings, text_column

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose distinct units are aligned at a time, and units that the tokenizers are asked for in one call.
BATCH_BYTES, ASKED = 6 << 20, 1 << 14
#: Aligned units that a worker keeps, about 120 bytes each; beyond it the half that was asked for last stays.
MOST_KEPT = 800_000
#: Memory of a task's DuckDB; its tables are those of one batch.
DUCKDB_MEMORY = "400MB"
#: A unit ends before a space or line feed that stands alone between two characters that aren't white space of any kind.
BOUND = re.compile(r"(?<=[^\s\u180e])(?=[ \n][^\s\u180e])")
#: Texts that Arrow can't cut: with other white space than single ones, or with the sign that it cuts at.
ODD = tokens.ODD + "|\\x00|\\x{180e}"

#: a, b: the tokens of one batch in order, as intervals of bytes of all its units.
GROUPS = """
WITH a_at AS (SELECT a.*, b.e = a.e AS cut, b.id AS other FROM a ASOF JOIN b ON a.e > b.s),
b_at AS (SELECT b.*, a.e = b.e AS cut FROM b ASOF JOIN a ON b.e > a.s)
SELECT true AS is_a, i, s, e, cut, other, sum(cut::BIGINT) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - cut::BIGINT AS g FROM a_at
UNION ALL
SELECT false, i, s, e, cut, NULL, sum(cut::BIGINT) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT - cut::BIGINT FROM b_at
"""
READS = {
    "a": "SELECT g, cut, other FROM grouped WHERE is_a ORDER BY i",
    "b": "SELECT g FROM grouped WHERE NOT is_a ORDER BY i",
    "overlaps": "SELECT x.g, count(*) AS n FROM grouped x JOIN grouped y ON x.g = y.g AND x.s < y.e AND y.s < x.e WHERE x.is_a AND NOT y.is_a GROUP BY x.g ORDER BY x.g",
}


#: Units of which the ids are surely told by the spaces that they begin with: a space and letters or signs, neither more white space nor the sign for it.
PLAIN = "^ [^\\s\\p{Z}\\p{C}▁]+$"
UNITS = pa.schema([("unit", pa.string()), ("ok", pa.bool_()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_overlaps")), ("groups", pa.string()), ("links", pa.list_(pa.int64()))])


class Vocabulary:
    """Each id's bytes, by id."""

    def __init__(self, entries: list[bytes]):
        self.entries = pa.array(entries, pa.binary())
        self.lengths = pc.binary_length(self.entries).to_numpy().astype(np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        data = self.entries.take(pa.array(ids)).buffers()[2]
        return data.to_pybytes() if data is not None else b""


def _byte_signs() -> dict[str, int]:
    """The sign that byte-level vocabularies write for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers of a worker and its DuckDB."""

    def __init__(self, a: str, b: str):
        import duckdb
        from sentencepiece import SentencePieceProcessor

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallelism
        self.a = tokens.tokenizer(tokens.public(a))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=tokens.public(b))
        signs, vocab = _byte_signs(), self.a.get_vocab()
        entries = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            entries[i] = bytes(signs[c] for c in word) if all(c in signs for c in word) else word.encode()
        self.a_words = Vocabulary(entries)
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size())]
        self.b_words = Vocabulary([bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces])
        self.space = self.b.piece_to_id("▁")
        self.a_bound, self.b_bound = (pc.starts_with(w.entries, b" ").to_numpy(zero_copy_only=False) for w in (self.a_words, self.b_words))
        self.known, self.asked, self.turn = UNITS.empty_table(), np.zeros(0, np.int32), 0
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})

    def _a_ids(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]

    def _b_ids(self, units: list[str]) -> list[list[int]]:
        """B puts a space before a text by itself, which stands for a unit's own; before a unit that begins with a line feed it has none."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [x if u[0] == " " else x[1:] if x[:1] == [self.space] else [] for u, x in zip(units, found, strict=True)]

    def _jointly(self, ids: np.ndarray, bound: np.ndarray, n: int) -> np.ndarray | None:
        """How many ids each of n units has, which were encoded as one text; None unless as many ids begin with a space as there are units. Each unit has one
        such id at least, its first, so that none has more then."""
        begins = np.flatnonzero(bound[ids])
        return np.diff(np.append(begins, len(ids))) if len(begins) == n else None

    def _ids(self, units: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Each side's ids of units, one after the other, and how many each has. Units of a space and a word are asked for in one text."""
        plain = pc.match_substring_regex(units, PLAIN).to_numpy(zero_copy_only=False)
        if plain.all() and len(units):
            text = "".join(units.to_pylist())
            ids = [np.asarray(self.a.encode(text, add_special_tokens=False).ids, np.int64), np.asarray(self.b.encode(text[1:], num_threads=1), np.int64)]
            counts = [self._jointly(x, bound, len(units)) for x, bound in zip(ids, (self.a_bound, self.b_bound), strict=True)]
            if all(n is not None for n in counts):
                return ids, counts
        listed, ids, counts = units.to_pylist(), [], []
        for ask in (self._a_ids, self._b_ids):
            some = ask(listed)
            counts.append(np.fromiter(map(len, some), np.int64, len(some)))
            ids.append(np.fromiter((x for one in some for x in one), np.int64, int(counts[-1].sum())))
        return ids, counts

    def _groups(self, sides: list[np.ndarray]) -> dict[str, pa.Table]:
        """What READS tells of the tokens of both sides, whose bytes are the same."""
        for name, ids, words in zip("ab", sides, (self.a_words, self.b_words), strict=True):
            ends = np.cumsum(words.lengths[ids])
            self.db.register(name, pa.table({"i": np.arange(len(ids)), "id": ids, "s": ends - words.lengths[ids], "e": ends}))
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE grouped AS {GROUPS}")
        out = {name: self.db.sql(q).to_arrow_table().combine_chunks() for name, q in READS.items()}
        self.db.execute("DROP TABLE grouped")
        for name in "ab":
            self.db.unregister(name)
        return out

    def align(self, units: pa.Array) -> pa.Table:
        """Per unit, in order: ok (both sides' bytes are the unit's), n_a, n_b, n_groups, n_overlaps, groups, links (A's id << 32 | B's). Nothing where not ok."""
        self.turn += 1
        at = pc.index_in(units, value_set=self.known.column("unit").combine_chunks())
        new = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy().astype(np.int64)
        at[new] = len(self.known) + np.arange(len(new))
        if len(new):
            some = units.take(pa.array(new))
            plain = pc.match_substring_regex(some, PLAIN)
            first = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")  # plain ones first, so that they are asked for together
            at[new[first]] = len(self.known) + np.arange(len(new))
            some = some.take(pa.array(first))
            cut = int(pc.sum(plain).as_py())
            bounds = [*range(0, cut, ASKED), *range(cut, len(some), ASKED), len(some)]
            parts = [self.known, *(self._aligned(some.slice(i, j - i)) for i, j in zip(bounds[:-1], bounds[1:], strict=True))]
            self.known = pa.concat_tables(parts).combine_chunks()
            self.asked = np.append(self.asked, np.zeros(len(new), np.int32))
        self.asked[at] = self.turn
        out = self.known.take(pa.array(at)).combine_chunks()
        if len(self.known) > MOST_KEPT:
            stay = np.sort(np.argsort(self.asked, kind="stable")[-(MOST_KEPT // 2) :])
            self.known, self.asked = self.known.take(pa.array(stay)).combine_chunks(), self.asked[stay]
        return out

    def _aligned(self, units: pa.Array) -> pa.Table:
        sides, counts = self._ids(units)
        ok = self._same(units, sides, counts)
        sides = [ids[np.repeat(ok, n)] for ids, n in zip(sides, counts, strict=True)]
        n_a, n_b = (np.where(ok, n, 0) for n in counts)
        got = self._groups(sides)
        told = []  # each side's ids, group by group
        for name, ids in zip("ab", sides, strict=True):
            g = got[name].column("g").to_numpy()
            begins = np.append(np.flatnonzero(np.diff(g, prepend=-1)), len(g)).astype(np.int32)
            told.append(pc.binary_join(pa.ListArray.from_arrays(begins, pa.array(ids).cast(pa.string())), ","))
        cut = got["a"].column("cut").to_numpy()
        links = (sides[0][cut] << 32) | got["a"].column("other").to_numpy()[cut]
        n_groups = _sums(cut.astype(np.int64), np.cumsum(n_a))  # each ends at a cut, and so does each unit
        offsets = pa.array(np.append(0, np.cumsum(n_groups)).astype(np.int32))
        groups = pc.binary_join(pa.ListArray.from_arrays(offsets, pc.binary_join_element_wise(*told, "|")), ";")
        n_overlaps = _sums(got["overlaps"].column("n").to_numpy(), np.cumsum(n_groups))
        return pa.table([units, ok, n_a, n_b, n_groups, n_overlaps, groups, pa.ListArray.from_arrays(offsets, pa.array(links))], UNITS)

    def _same(self, units: pa.Array, sides: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Whether the tokens' bytes of both sides are the unit's own."""
        lengths = pc.binary_length(units).to_numpy().astype(np.int64)
        ok = np.ones(len(units), bool)
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units.cast(pa.binary())), b"")[0].as_py()
        for ids, n, words in zip(sides, counts, (self.a_words, self.b_words), strict=True):
            ends = np.cumsum(n)
            ok &= _sums(words.lengths[ids], ends) == lengths
            if ok.all() and words.joined(ids) == text:
                continue
            for j in np.flatnonzero(ok):
                ok[j] = words.joined(ids[ends[j] - n[j] : ends[j]]) == units[int(j)].as_py().encode()
        return ok


NUMBERS = ("n_a", "n_b", "n_groups", "n_overlaps")


def cut(texts: pa.Array) -> pa.ListArray:
    """The units of a space and each text; none of an empty text."""
    odd = pc.match_substring_regex(texts, ODD)
    easy = texts.filter(pc.invert(odd))
    marked = pc.replace_substring(pc.replace_substring(easy, "\n", "\0\n"), " ", "\0 ")
    units = pc.split_pattern(pc.binary_join_element_wise("", marked, " "), "\0")
    mask = odd.to_numpy(zero_copy_only=False)
    if mask.any():
        hard = pa.array([BOUND.split(f" {t}") for t in texts.filter(odd).to_pylist()], units.type)
        units = pa.concat_arrays([units, hard]).take(pa.array(np.argsort(np.append(np.flatnonzero(~mask), np.flatnonzero(mask)))))
    return units


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end at each place."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return np.diff(total[np.append(0, ends)])


def _aligned(docs: DataFrame, id_col: str, text_col: str, a: str, b: str, whole: bool) -> DataFrame:
    """Per row its counts, groups (or their checksum) and distinct links with their number; besides, per task, rows that count links: code, n."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", *NUMBERS, "groups", "codes", "times", "code", "n"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_overlaps long, groups string, codes array<long>, times array<long>, code long, n long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = held(f"alignment {a} {b}", lambda: Pair(a, b))
        counted, id_type = (np.zeros(0, np.int64), np.zeros(0, np.int64)), pa.null()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for some in slices(batch, BATCH_BYTES):
                texts = pc.fill_null(strings(some.column("text")), "")
                rows = np.flatnonzero(pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
                result = _rows(pair, texts.take(pa.array(rows)), whole) if len(rows) else None
                at = np.full(len(texts), -1)
                at[rows] = np.arange(len(rows))
                index = pa.array(at, mask=at < 0)
                columns = [some.column("doc_id")]
                for c, empty in (*((c, 0) for c in NUMBERS), ("groups", ""), ("codes", []), ("times", [])):
                    kind = pa.int64() if c in NUMBERS else pa.string() if c == "groups" else pa.list_(pa.int64())
                    got = pa.nulls(len(texts), kind) if result is None else result[c].take(index)
                    columns.append(pc.fill_null(got, pa.scalar(empty, kind)))
                nulls = pa.nulls(len(texts), pa.int64())
                yield pa.record_batch([*columns, nulls, nulls], names)
                if result is not None:
                    counted = _merged(counted, (result["codes"].flatten().to_numpy(), result["times"].flatten().to_numpy()))
        n = len(counted[0])
        if n:
            none = [pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in NUMBERS), pa.nulls(n, pa.string()), *(pa.nulls(n, pa.list_(pa.int64())) for _ in range(2))]
            yield pa.record_batch([*none, pa.array(counted[0]), pa.array(counted[1])], names)

    return mapped(docs.select(F.col(id_col).alias("doc_id"), text_column(text_col).alias("text")), work, schema)


def _merged(*parts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)


def _rows(pair: Pair, texts: pa.Array, whole: bool) -> dict[str, pa.Array]:
    """The counts, groups and links of texts that aren't empty, put together from those of their units."""
    units = cut(texts)
    told = units.flatten().dictionary_encode()
    found, of = pair.align(told.dictionary), told.indices.to_numpy()
    ends = np.cumsum(pc.list_value_length(units).to_numpy())
    column = lambda c: found.column(c).to_numpy()
    ok = _sums(~column("ok")[of], ends) == 0
    out = {c: pa.array(np.where(ok, _sums(column(c)[of], ends), 0)) for c in NUMBERS}
    groups = pc.binary_join(pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), found.column("groups").combine_chunks().take(told.indices)), ";")
    if whole:
        out["groups"] = pc.if_else(pa.array(ok), groups, "")
    else:
        out["groups"] = pa.array([hashlib.sha256(g.as_buffer()).hexdigest() if k else "" for g, k in zip(groups, ok, strict=True)])
    lists = found.column("links").combine_chunks()
    codes, local = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    first, n = lists.offsets.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    keep = ok[row]
    of, row = of[keep], row[keep]
    each = n[of]
    at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[of], each)
    keys, times = np.unique(np.repeat(row, each) * max(1, len(codes)) + local[at], return_counts=True)
    row, local = np.divmod(keys, max(1, len(codes)))
    offsets = np.searchsorted(row, np.arange(len(ends) + 1)).astype(np.int32)
    out["codes"] = pa.ListArray.from_arrays(offsets, pa.array(codes[local]))
    out["times"] = pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int64)))
    return out


def _counts(parts: DataFrame) -> DataFrame:
    """a_id, b_id, n: how many links of the corpus hold this pair; is_best: none with the same B is linked more often. A row a pair that occurs."""
    sums = parts.where("code is not null").groupBy("code").agg(F.sum("n").alias("n"))
    sums = sums.select(F.shiftrightunsigned("code", 32).alias("a_id"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n")
    best = sums.groupBy("b_id").agg(F.max("n").alias("most"))
    return sums.join(best, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("is_best"))


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B) -> DataFrame:
    """The tokens that stand for each other: a_id, b_id, n, is_best, over all texts. See align()."""
    return _counts(_aligned(docs, id_col, text_col, a, b, False))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B) -> DataFrame:
    """Per row: doc_id, n_a, n_b (tokens), n_groups, n_overlaps (pairs of tokens that share a byte), groups (`a1,a2|b1;a3|b2,b3`), links: array of
    (a_id, b_id, n), distinct pairs whose byte ranges end together and how often they do in this text.

    Null and empty texts, and texts of which a side's joined bytes aren't a space and the text, have no tokens: zeros, '' and no links. Bytes that aren't
    UTF-8 are read as U+FFFD first. Rows are taken one by one, whatever their ids: repeated and null ones stay apart. Special tokens' strings are plain text.
    Columns besides the two aren't read; an empty table gives an empty one."""
    links = F.transform(F.arrays_zip("codes", "times"), lambda x: F.struct(F.shiftrightunsigned(x["codes"], 32).alias("a_id"), x["codes"].bitwiseAND(0xFFFFFFFF).alias("b_id"), x["times"].alias("n")))
    return _aligned(docs, id_col, text_col, a, b, True).where("code is null").select("doc_id", *NUMBERS, "groups", links.alias("links"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps. Edge cases as in align()."""
    spark = docs.sparkSession
    parts = staged(_aligned(docs, id_col, text_col, a, b, False), "aligned")
    # At most a row for each byte of both vocabularies' tokens (see above), so it has a bound that doesn't grow with the corpus.
    counts = _counts(parts).toArrow()
    code = np.left_shift(counts.column("a_id").to_numpy(), 32) | counts.column("b_id").to_numpy()
    order = np.argsort(code)
    table = spark.sparkContext.broadcast((code[order], counts.column("n").to_numpy()[order], counts.column("is_best").to_numpy()[order].astype(np.int64)))
    kind = docs.schema[id_col].dataType.simpleString()
    told = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = table.value
        for batch in batches:
            codes, times = batch.column("codes").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            ends = np.cumsum(pc.list_value_length(batch.column("codes")).to_numpy())
            at = np.searchsorted(known, codes)
            numbers = (_sums(times, ends), _sums(times * best[at], ends), _sums(times * n[at], ends)) if len(codes) else (np.zeros(batch.num_rows, np.int64),) * 3
            yield pa.record_batch([*(batch.column(c) for c in told[:4]), *map(pa.array, numbers), batch.column("groups"), batch.column("n_overlaps")], told)

    rows = parts.where("code is null").select("doc_id", *NUMBERS, "groups", "codes", "times")
    return mapped(rows, look, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in told[1:7]) + ", groups_sha256 string, n_overlaps long")
