"""Operators against plain versions of what they promise, on the smallest tables."""

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from daygrain.llm import crc32c, lattice, lm, minhash, packing, queries, records, secrets, simhash, tokens
from daygrain.llm.common import scratch


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, sf, texts):
    def one(t):
        w = t.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    ids = sorted(texts)
    fp = [one(texts[i]) for i in ids]
    root = union(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fp[a] ^ fp[b]).count("1") <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op2_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp[k]:016x}", ids[root[k]]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("distance", [1, 3, 6])
def test_pigeonhole_loses_no_link(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, distance + 2), replace=False)) for x in np.repeat(base, 5)]
    fps = sorted({int(x) for x in base} | set(near))
    root = union(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= distance])
    got = dict(simhash.classes(spark.createDataFrame([(x,) for x in fps], "fp long"), distance).collect())
    assert [got.get(x, x) for x in fps] == [fps[r] for r in root]
    parts = simhash.choose(spark.createDataFrame([(x,) for x in fps], "fp long"), distance)
    assert sum(p.threshold + 1 for p in parts) == distance + 1 and sorted(b for p in parts for b in p.bits) == list(range(64))


def test_secrets(spark, sf, texts):
    got = {r["doc_id"]: r for r in queries.op9_secret_scan(spark, sf).collect()}
    for i, t in texts.items():
        base = sorted((m.start(), k, f"{r.kind}:{m.start()}:{m.end()}") for k, r in enumerate(secrets.BASE) for m in r.compiled().finditer(t) if m.end(r.group) - m.start(r.group) >= r.least)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(b[2] for b in base).encode()).hexdigest()
    planted = "x" * 50 + " xoxb-1234567890ab and gh" + "p_" + "A" * 36 + " AKIA" + "Z" * 20
    assert [secrets.RULES[k].kind for _, _, k in secrets.find([planted.encode()])[0]] == ["chat", "code_host", "access"]


def test_language_model(spark, sf, texts):
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    count: dict = {}
    for t in train:
        for w in lm.tokens([t.encode()])[0]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    held = np.zeros(3)
    for r in queries.op5_log_bilinear(spark, sf).collect():
        w = lm.tokens([texts[r["doc_id"]].encode()])[0]
        want = sum(np.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want) and r["train_tokens"] == n and r["n_known"] == sum(x in count for x in w)
        held += np.array([r["score"], r["base_score"], r["n_tokens"]]) * r["held_out"]
    assert held[0] / held[2] > held[1] / held[2] + 0.1  # the model tells more of texts that it hasn't seen


def test_language_model_scores_by_its_tables(spark, sf, texts):
    """Each text's score again, token by token, from the model's tables and all counts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = lm.fit(docs)
    count = {bytes(r["word"]): r["n"] for r in m.counts.collect()}
    classes, end = lm._Classes(m.vocabulary), int(lm._Classes(m.vocabulary)([lm.END])[1][0])
    own = m.vocabulary.settings.own
    mass = np.zeros(m.vocabulary.settings.shared)
    room = np.zeros(len(mass))
    for w, n in count.items():
        c = int(classes([w])[1][0])
        if c >= own:
            mass[c - own] += n
            room[c - own] += 1
    for r in lm.scored(docs, m).limit(40).collect():
        words = lm.tokens([texts[r["doc_id"]].encode()])[0]
        cls = classes(words)[1].astype(int).tolist()
        before, total = [end] * 3, 0.0
        for w, c in zip(words, cls, strict=True):
            total += float(m.tables.log_p(*(np.array([x]) for x in (*before, c)))[0])
            if c >= own:
                total += np.log10(count.get(w, 0) + 0.1) - np.log10(mass[c - own] + 0.1 * (room[c - own] + 1))
            before = [c, *before[:2]]
        assert abs(total - r["score"]) < 1e-4 * abs(total)


def test_log_bilinear_is_normalised_and_reads_all_positions():
    """After every context the probabilities sum to 1, and a model of tokens that only one of the three positions tells predicts them by it."""
    s = lm.Settings(own=6, shared=2, groups=(8, 8, 8), width=6, steps=(120, 400), rate=(0.05, 0.05), patience=50)
    rng = np.random.default_rng(0)
    every = np.stack(np.meshgrid(*[np.arange(8)] * 4, indexing="ij"), -1).reshape(-1, 4)
    for place in range(3):
        drawn = rng.integers(0, 8, (6000, 4))
        drawn[:, 3] = (drawn[:, place] * 3 + 1) % 8
        back = np.arange(len(drawn)) % 8 // 7
        pairs = np.zeros((2, 8, 8), int)
        np.add.at(pairs, (back, drawn[:, 0], drawn[:, 3]), 1)

        def triples(group, back=back, drawn=drawn):
            sizes = [int(g.max()) + 1 for g in group]
            out = np.zeros((2, int(np.prod(sizes)), 8), int)
            at = (group[0][drawn[:, 0]] * sizes[1] + group[1][drawn[:, 1]]) * sizes[2] + group[2][drawn[:, 2]]
            np.add.at(out, (back, at, drawn[:, 3]), 1)
            return out

        t = lm.train(pairs, triples, s)
        p = 10.0 ** t.log_p(*every.T).astype(float)
        assert np.allclose(p.reshape(-1, 8).sum(1), 1, atol=1e-4)
        assert p[every[:, 3] == (every[:, place] * 3 + 1) % 8].mean() > 0.5


def test_packing_and_records_round_trip(spark, sf, texts):
    t = tokens.tokenizer(tokens.public("word_bpe_49k.json"))
    ids = {i: np.asarray([*t.encode(x, add_special_tokens=False).ids, 2], "<u4") for i, x in texts.items()}
    for r in queries.op4_harmonic_packing(spark, sf).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
    shards = records.write(spark.read.parquet(f"{sf}/documents.parquet"), scratch(spark, "test"))
    there = {r["doc_id"]: bytes(r["ids"]) for r in records.read(shards).collect()}
    shuffled = records.read_shuffled(shards, 3).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in shuffled} == there and [r["doc_id"] for r in shuffled] != sorted(there, key=int)
    b = tokens.tokenizer(tokens.public("byte_bpe_50k.json"))
    assert there == {str(i): np.asarray([*b.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, x in texts.items()}


def test_damage_is_seen():
    record = records.frame([b"payload"])[0]
    assert records.unframe(record, [0], [7]) == [b"payload"]
    with pytest.raises(ValueError):
        records.unframe(record[:14] + b"X" + record[15:], [0], [7])
    assert crc32c.crc32c([b"123456789"])[0] == 0xE3069283


def test_cuts_cover_and_fit():
    for n in [1, 2, 63, 64, 65, 1365, 1366, 2047, 2048, 2049, 4095, 4096, 4097, 9999, 123_457]:
        parts = packing.cuts(n)
        assert sum(parts) == n and all(0 < p * packing.class_of(p) <= packing.CAPACITY for p in parts)


def test_encoder_is_the_tokenizer():
    odd = ["", " ", "a  b", "\n", "a\nb", " lead", "trail ", "x<|endoftext|>y", "don't I'll", "a\tb", "é́ x", "12 345a!?", "a\x01b c", "word, word. word!", " x"]
    for name, spaces in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        e = tokens.Encoder(tokens.public(name), spaces, 10)
        assert e.encode_all(pa.array(odd * 2)) == [e.whole(x) for x in odd * 2]


def test_minhash_estimates(texts):
    s = minhash.Settings()
    errors = []
    for t in list(texts.values())[:60]:
        a, b = minhash.shingles(t.encode(), 5), minhash.shingles((t[: len(t) * 3 // 4] + " other words at the end of it").encode(), 5)
        j = len(set(a) & set(b)) / max(1, len(set(a) | set(b)))
        errors.append(abs(minhash.likeness(minhash.signature(a, s), minhash.signature(b, s)) - j))
    assert np.mean(errors) < 0.05


def test_lattice_finds_planted_links(spark):
    """Vectors of four lengths with copies at cosines about the bound, labels that are strings; all links by hand."""
    rng, rows = np.random.default_rng(3), []
    for dim in (16, 64, 256, 768):
        for i in range(120):
            v = rng.normal(size=dim)
            v /= np.linalg.norm(v)
            rows.append((len(rows), v, f"l{i % 3}"))
            w = rng.normal(size=dim)
            w -= (w @ v) * v
            w /= np.linalg.norm(w)
            c = rng.uniform(0.975, 0.9995)
            rows.append((len(rows), c * v + np.sqrt(1 - c * c) * w, f"l{i % 3}" if i % 5 else "other"))
    links = {i: set() for i, _, _ in rows}
    for (i, v, a), (j, w, b) in itertools.combinations(rows, 2):
        if len(v) == len(w) and a == b and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
            links[i].add(j)
            links[j].add(i)
    table = spark.createDataFrame([(i, v.tolist(), a) for i, v, a in rows], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r for r in lattice.near(table).collect()}
    assert sum(map(len, links.values())) > 500
    assert all(got[i]["n_links"] <= len(x) for i, x in links.items())
    assert sum(got[i]["n_links"] for i in links) >= 0.9 * sum(map(len, links.values()))
    assert all(got[i]["component_id"] in {i, *x} for i, x in links.items())  # pairs only


def test_lattice(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.asarray([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.asarray([r["label"] for r in rows])
    on = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(on, False)
    got = {r["vec_id"]: r["n_links"] for r in queries.op10_lattice(spark, sf).collect()}
    assert sum(got.values()) >= 0.9 * on.sum() and all(got[r["vec_id"]] <= k for r, k in zip(rows, on.sum(1), strict=True))
    points, d = lattice.decode(np.random.default_rng(0).normal(size=(200, 8)) * 2, 1)
    assert (d <= 1 + 1e-9).all() and (points.sum((1, 2)) % 4 == 0).all()  # E8's covering radius is 1
