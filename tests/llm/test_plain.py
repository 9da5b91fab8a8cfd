"""The operators that SQL can't state against plain Python over the whole smallest tables: scores, languages, fingerprints, near-duplicates, the pipeline."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from daygrain.llm import langid, minhash, packing, quality, queries, secrets, tokens
from daygrain.llm.common import held_out, table
from tests.llm.test_jaccard import kept


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [r.asDict() for r in table(spark, sf, "documents").orderBy("doc_id").collect()]


def plain_quality(model, text, declared):
    """The factorisation machine by its definition: every pair of features once."""
    _, cols, x = quality.features([text.encode()], [declared])
    v = model.v[cols].astype(float) * x[:, None]
    both = v @ v.T
    z = model.w0 + float((model.w[cols].astype(float) * x).sum()) + float(both[np.triu_indices(len(x), 1)].sum())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_quality_is_the_sum_over_all_pairs(spark, sf, docs):
    labels = table(spark, sf, "labels")
    model = quality.fit(table(spark, sf, "documents"), labels, leave=held_out(F.col("doc_id"), 4, 2))
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, sf).collect()}
    for d in docs:
        r = got[d["doc_id"]]
        assert abs(r["score"] - plain_quality(model, d["text"] or "", d["n_chars"])) < 1e-3
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    told = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if got[r["doc_id"]]["held_out"] and r["quality"] is not None]
    assert np.mean([a == b for a, b in told]) >= 0.85


def plain_grams(text):
    chars = re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", text.lower())
    mask, out = 0xFFFFFFFF, Counter()
    shift = 32 - langid.BUCKETS.bit_length() + 1
    one = [ord(c) * 0x9E3779B1 & mask for c in chars]
    two = [((a ^ (ord(c) * 0x85EBCA6B & mask)) * 0xC2B2AE35) & mask for a, c in zip(one, chars[1:], strict=False)]
    three = [((a ^ (ord(c) * 0x27D4EB2F & mask)) * 0x165667B1) & mask for a, c in zip(two, chars[2:], strict=False)]
    for g in (*one, *two, *three):
        out[g >> shift] += 1
    return out


def test_language_is_the_nearest_centroid(spark, sf, docs):
    model = langid.fit(table(spark, sf, "documents"), leave=held_out(F.col("doc_id"), 3, 1))
    got = {r["doc_id"]: r for r in queries.op3_language(spark, sf).collect()}
    right = []
    for d in docs:
        r, text = got[d["doc_id"]], d["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        x = np.zeros(langid.BUCKETS)
        for g, n in plain_grams(text).items():
            x[g] = math.log1p(n) * model.idf[g]
        x /= np.linalg.norm(x)
        cosine = [float(sum(a * b for a, b in zip(x[x > 0], c[x > 0], strict=True))) for c in model.centroids]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert abs(r["score"] - min(1.0, max(0.0, cosine[best]))) < 1e-3
        others = [c for k, c in enumerate(cosine) if model.of[k] != model.of[best]]
        assert r["lang_pred"] == model.langs[model.of[best]] or cosine[best] - max(others) < 1e-3
        if r["held_out"] and d["lang"] is not None:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 30 and np.mean(right) >= 0.95


def plain_fingerprint(text, s):
    a, b = (x.tolist() for x in minhash.permutations(s))
    x = set(minhash.shingles(text.encode(), s.words).tolist())
    return [min(((y * p + q) & 0xFFFFFFFF for y in x), default=0xFFFFFFFF) & 0xFFFF for p, q in zip(a, b, strict=True)]


def test_minhash_of_edited_texts(spark, sf, docs):
    s = minhash.Settings()
    got = {r["doc_id"]: r for r in queries.op8_minhash(spark, sf).collect()}
    assert len(got) == len(docs)
    texts = [d["text"] or "" for d in docs]
    for k, d in enumerate(docs):
        r, t, after = got[d["doc_id"]], texts[k], texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        new = t[: len(t) - cut] + after[:cut]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        if len(t) < 3000 and len(after) < 3000:
            f, e, n = (plain_fingerprint(x, s) for x in (t, new, after))
            same = lambda x, y: sum(a == b for a, b in zip(x, y, strict=True)) / len(x)
            assert r["fingerprint"] == "".join(f"{x:04x}" for x in f) and r["edited_fingerprint"] == "".join(f"{x:04x}" for x in e)
            assert abs(r["near_edited"] - same(f, e)) < 1e-9 and abs(r["near_next"] - same(f, n)) < 1e-9


def test_minhash_bands_and_jaccard(spark, docs):
    """Classes by bands and exact Jaccard are those of all pairs, but for pairs that no band shows (0.2 % at 0.8)."""
    near = [("the quick brown fox jumps over the lazy dog and runs far away over many hills " * 6).split() for _ in range(3)]
    near[1][4], near[2][60] = "slow", "never"
    rows = [(d["doc_id"], d["text"]) for d in docs] + [(10_000 + k, " ".join(w)) for k, w in enumerate(near)]
    out = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: set(minhash.shingles((t or "").encode(), 5).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = sum(out[a] == out[b] for a, b in pairs)
    assert found >= 0.9 * len(pairs) > 0
    assert all(find(i) == find(c) for i, c in out.items())


def plain_redacted(text):
    spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in r.compiled().finditer(text) if m.end(r.group) - m.start(r.group) >= r.least)
    out, at = "", 0
    while spans:
        start, end = spans.pop(0)
        while spans and spans[0][0] < end:
            end = max(end, spans.pop(0)[1])
        out, at = out + text[at:start] + "[secret]", end
    return out + text[at:]


def plain_mix(rows):
    """How often each row is taken: finish times of both epochs, sorted, until the budget is spent."""
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in rows}
    by = defaultdict(list)
    for d in rows:
        by[d["source"]].append(d["doc_id"])
    sources = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in by[s]) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    left, open_, goal = 1.5 * sum(total.values()), list(sources), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] > 2 * total[s]]
        goal |= {s: 2.0 * total[s] for s in full} if full else share
        left -= sum(goal[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    line = []
    for s in sources:
        run = 0
        for i in sorted(by[s], key=lambda i: (hashlib.md5(f"mix|{i}".encode()).hexdigest(), i)):
            run += size[i]
            line += [((run + e * total[s]) / goal[s] if goal[s] else math.inf, i, size[i], e) for e in (0, 1)]
    room, taken = math.floor(sum(goal.values()) + 0.25), Counter()
    for _, i, n, _ in sorted(line):
        taken[i] += min(n, room) > 0
        room -= min(n, room)
    return taken


def test_pipeline_stage_by_stage(spark, sf, docs):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    raw = table(spark, sf, "documents")
    columns = raw.columns
    model = quality.fit(raw, table(spark, sf, "labels"))

    good = stages["quality"](spark, raw, sf)
    rows = [r.asDict() for r in good.collect()]
    told = {d["doc_id"]: plain_quality(model, d["text"] or "", d["n_chars"]) for d in docs}
    assert all(abs(s - 0.7) < 1e-3 or (s >= 0.7) == (i in {r["doc_id"] for r in rows}) for i, s in told.items())

    apart = stages["near_duplicates"](spark, spark.createDataFrame(rows, raw.schema), sf)
    want, _ = kept([(r["doc_id"], r["text"]) for r in rows])
    rows = [r.asDict() for r in apart.collect()]
    assert sorted(r["doc_id"] for r in rows) == want and apart.columns == columns

    clean = stages["secrets"](spark, spark.createDataFrame(rows, raw.schema), sf)
    want = {r["doc_id"]: plain_redacted(r["text"] or "") for r in rows}
    rows = [r.asDict() for r in clean.collect()]
    assert {r["doc_id"]: r["text"] or "" for r in rows} == want and clean.columns == columns

    mixed = stages["mixing"](spark, spark.createDataFrame(rows, raw.schema), sf)
    want = plain_mix(rows)
    rows = [r.asDict() for r in mixed.collect()]
    assert Counter(r["doc_id"] for r in rows) == +want and mixed.columns == columns

    pieces = stages["packing"](spark, spark.createDataFrame(rows, raw.schema), sf).collect()
    t = tokens.tokenizer(tokens.public("word_bpe_49k.json"))
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in rows}
    seen = Counter()
    for p in pieces:
        part = np.asarray(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(part) == p["length"] and zlib.crc32(part.tobytes()) == p["ids_crc32"]
        for at in range(p["start"], p["start"] + p["length"]):
            seen[p["doc_id"], at] += 1
    copies = Counter(r["doc_id"] for r in rows)
    assert all(n == copies[i] for (i, _), n in seen.items()) and len(seen) == sum(map(len, ids.values()) if len(ids) == len(copies) else [])
    check_sequences(pieces, sum(len(ids[i]) * n for i, n in copies.items()))


def check_sequences(pieces, total):
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sorted(by) == list(range(len(by)))
    for some in by.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    least = -(-total // packing.CAPACITY)
    assert len(by) <= 1.02 * least + 5


def test_packing_pads_little(spark, sf):
    pieces = queries.op4_harmonic_packing(spark, sf).collect()
    check_sequences(pieces, sum(p["length"] for p in pieces))


def test_token_records_query(spark, sf, docs):
    t = tokens.tokenizer(tokens.public("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in queries.op7_token_records(spark, sf).collect()}
    start = 0
    for d in docs:
        ids = np.asarray([*t.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_the_pipeline_runs_as_one(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns)
    rows = out.collect()
    check_sequences(rows, sum(p["length"] for p in rows))
