"""Windows of words, collocations and token alignment against plain versions, over whole tables, with small settings that force every path, and on hard rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daygrain.llm import alignment, phrases, queries, superkmers
from tests.llm.test_edges import ALL, CLASHING, DOCS, SCHEMA, ids

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def hard(spark):
    d = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    return d.withColumns({c: F.lit("clash") for c in CLASHING} | {"chunk": F.lit(1), "key": F.lit("k"), "runs": F.lit(2), "bucket": F.lit(3), "codes": F.lit(4), "n_a": F.lit(5)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- windows of words


def windows_gone(rows, k):
    """(id, words, removed, checksum of what stays) of each row; a null id is behind all others."""
    key = lambda i: (i is None, i or 0)
    words, least = [], {}
    for i, t in rows:
        w = SPACE.findall((t or "").encode())
        words.append((i, w))
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            least[g] = min(least.get(g, key(i)), key(i))
    out = []
    for i, w in words:
        gone = {x for j in range(len(w) - k + 1) if least[tuple(w[j : j + k])] < key(i) for x in range(j, j + k)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for n, x in enumerate(w) if n not in gone)).hexdigest()))
    return sorted(out, key=str)


def test_windows(docs, rows, spark, sf):
    got = sorted((tuple(r) for r in queries.op11_superkmers(spark, sf).collect()), key=str)
    assert got == windows_gone([r[:2] for r in rows], 13) and sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("settings", [superkmers.Settings(window=4, gram=2, bucket=100, hot=5), superkmers.Settings(window=1, gram=3), superkmers.Settings(window=7, gram=7, bucket=50, hot=2)])
def test_windows_of_any_length_with_small_buckets_and_hot_grams(docs, rows, settings, monkeypatch):
    monkeypatch.setattr(superkmers, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(superkmers, "FOLD_BYTES", 500)
    got = sorted((tuple(r) for r in superkmers.digest(docs, settings=settings).collect()), key=str)
    assert got == windows_gone([r[:2] for r in rows], settings.window)


def test_windows_spans_are_the_words_that_go(docs, rows):
    text = {i: SPACE.findall((t or "").encode()) for i, t, _ in rows}
    for r in superkmers.dedupe(docs).collect():
        gone = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert len(gone) == r["n_removed"] and bytes(r["text"]) == b" ".join(w for i, w in enumerate(text[r["doc_id"]]) if i not in gone)
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))


def test_windows_hard_rows(hard, none, spark):
    out = superkmers.digest(hard)
    assert ids(out) == ALL and sorted((tuple(r) for r in out.collect()), key=str) == windows_gone([d[:2] for d in DOCS], 13)
    assert superkmers.digest(none).count() == 0
    same = spark.createDataFrame([(5, "a b c d e f"), (5, "x a b c d e f"), (5, "a b c d e f"), (None, "b c d e"), (None, "b c d e")], "doc_id long, text string")
    got = superkmers.digest(same, settings=superkmers.Settings(window=3)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 4), (0, 4), (5, 0), (5, 0), (5, 0)]
    named = same.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text").unionByName(spark.createDataFrame([("a", "c d e"), ("", "e f")], "doc_id string, text string"))
    got = superkmers.digest(named, settings=superkmers.Settings(window=2)).collect()
    assert sorted(("~" if r["doc_id"] is None else r["doc_id"], r["n_removed"]) for r in got) == [("", 0), ("a", 0), ("d5", 4), ("d5", 4), ("d5", 4), ("~", 4), ("~", 4)]


def test_windows_keep_damaged_bytes(spark):
    d = spark.createDataFrame([(1, bytearray(b"a \xff b c")), (2, bytearray(b"z a \xff b"))], "doc_id long, text binary")
    got = {r["doc_id"]: bytes(r["text"]) for r in superkmers.dedupe(d, settings=superkmers.Settings(window=3)).collect()}
    assert got == {1: b"a \xff b c", 2: b"z"}


# --- collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least=10, most=2000, share=50):
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (t or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, w), a in found.items():
        for part in (w[:2], w[1:]) if len(w) == 3 else ():
            longest[lang, part] = max(longest[lang, part], a)
    told = {}
    for (lang, w), a in found.items():
        if len(w) == 2 and longest[lang, w] and 100 * longest[lang, w] >= share * a:
            continue
        s, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        told.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, some in told.items() for i, (s, a, p, x, y) in enumerate(sorted(some)[:most]))


def test_collocations(spark, sf, rows):
    assert sorted(tuple(r) for r in queries.op12_phrases(spark, sf).collect()) == plain_collocations([(r[2], r[1]) for r in rows])


def test_collocations_over_many_small_chunks_and_buckets(docs, rows, monkeypatch):
    for name, n in (("CHUNK_BYTES", 30_000), ("WORD_BYTES", 20_000), ("PAIR_WORDS", 3_000)):
        monkeypatch.setattr(phrases, name, n)
    got = sorted(tuple(r) for r in phrases.collocations(docs.repartition(5), least=3, most=300, share=80).collect())
    assert got == plain_collocations([(r[2], r[1]) for r in rows], 3, 300, 80) and len(got) > 500


def test_collocations_hard_rows(hard, none, spark):
    assert sorted(tuple(r) for r in phrases.collocations(hard, least=2).collect()) == plain_collocations([(d[2], d[1]) for d in DOCS], 2)
    assert phrases.collocations(none).count() == 0
    d = spark.createDataFrame([(None, "A b\tC, a B c! a  b. b c"), ("und", "a b c"), ("x", ""), ("y", None)], "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(d, least=1).collect()) == plain_collocations([(r["lang"], r["text"]) for r in d.collect()], 1)


def test_scores_are_exact_beyond_64_bits(spark):
    big = spark.createDataFrame([(3 * 10**15, 3 * 10**15 + 1, 4 * 10**15), (10**15 + 7, 10**15 + 9, 10**15 + 11)], "a long, l long, r long")
    for r in big.select("a", "l", "r", phrases._score("a", "l", "r").alias("s")).collect():
        assert r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"])


# --- alignment of tokens


def plain_alignment(pair, text):
    """(ids of A, ids of B, groups as lists of both, linked pairs) of a text, whole."""
    full = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    words = [[w.entries[i].as_py() for i in x] for x, w in ((a, pair.a_words), (b, pair.b_words))]
    if not text or any(b"".join(w) != full for w in words):
        return [], [], "", []
    ends = [np.cumsum([len(x) for x in w]).tolist() for w in words]
    at = [dict(zip(e, x, strict=True)) for e, x in zip(ends, (a, b), strict=True)]
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        x, y = i, j
        while i < len(a) and ends[0][i] <= cut:
            i += 1
        while j < len(b) and ends[1][j] <= cut:
            j += 1
        groups.append(f"{','.join(map(str, a[x:i]))}|{','.join(map(str, b[y:j]))}")
    return a, b, ";".join(groups), [(at[0][e], at[1][e]) for e in sorted(set(ends[0]) & set(ends[1]))]


def check_alignment(got, rows, pair):
    told = [(i, *plain_alignment(pair, t or "")) for i, t in rows]
    count = Counter(p for x in told for p in x[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = [
        (i, len(a), len(b), len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for i, a, b, g, links in told
    ]
    assert sorted((tuple(r)[:8] for r in got), key=str) == sorted(want, key=str)


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.A, alignment.B)


def test_alignment(spark, sf, rows, pair):
    check_alignment(queries.op13_token_alignment(spark, sf).collect(), [r[:2] for r in rows], pair)


ODD = ["", " ", "a  b", "\n", "a\nb", "a\n\nb c", " lead", "trail ", "x<|endoftext|>y <s> </s> <unk> <0x0A>", "don't I'll", "a\tb", "é́ x", "a\x01b c", "a\x00b c", " x", "▁x y", "a ▁ b", "a　b", "①②③ 日本語 text", "x" * 3000, "᠎ a b", "🙂 b🙂 c", "<0xE2> ok", "A.\n B"]


def test_alignment_of_odd_texts_and_hard_rows(hard, none, spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_KEPT", 4)
    d = spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate(ODD * 2)], "doc_id long, text string").repartition(2)
    check_alignment(alignment.digest(d).collect(), [(i % 7 or None, t) for i, t in enumerate(ODD * 2)], pair)
    out = alignment.digest(hard)
    assert ids(out) == ALL
    check_alignment(out.collect(), [d[:2] for d in DOCS], pair)
    assert alignment.digest(none).count() == alignment.align(none).count() == alignment.pair_counts(none).count() == 0
    damaged = spark.createDataFrame([(1, bytearray(b"a \xff b"))], "doc_id long, text binary")
    check_alignment(alignment.digest(damaged).collect(), [(1, "a � b")], pair)


def test_alignment_tells_groups_links_and_overlaps(spark, pair):
    texts = ["Unbelievably, straße 日本 costs 12,345.67!", "tokenization of tokenizers"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    total = Counter()
    for r in alignment.align(d).collect():
        a, b, groups, links = plain_alignment(pair, texts[r["doc_id"]])
        assert r["groups"] == groups and Counter({(x["a_id"], x["b_id"]): x["n"] for x in r["links"]}) == Counter(links)
        ends = [np.cumsum([w.lengths[i] for i in x]) for x, w in ((a, pair.a_words), (b, pair.b_words))]
        begins = [np.append(0, e[:-1]) for e in ends]
        assert r["n_overlaps"] == int(((begins[0][:, None] < ends[1][None]) & (begins[1][None] < ends[0][:, None])).sum())
        total.update(links)
    got = {(r["a_id"], r["b_id"]): (r["n"], r["is_best"]) for r in alignment.pair_counts(d).collect()}
    assert got == {p: (n, n == max(m for (_, b), m in total.items() if b == p[1])) for p, n in total.items()}


def test_units_are_cut_where_both_tokenizers_end_a_token(pair):
    for t in ODD[1:]:
        units = alignment.cut(pa.array([t])).flatten().to_pylist()
        assert "".join(units) == " " + t
    assert alignment.cut(pa.array(["a b\nc", "", "d  e"])).to_pylist() == [[" a", " b", "\nc"], [" "], [" d  e"]]
