"""SimHash near-dedup by exact Jaccard similarity against plain Python, with planted copies about the similarity that counts."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from daygrain.llm import jaccard, simhash


def plain(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Ids that stay: the smallest of each component of pairs with a similarity of 0.8 or more, and how many pairs lie in 0.8 to 0.95."""
    sets, root, some = {i: plain(t) for i, t in rows}, {i: i for i, _ in rows}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if 5 * both >= 4 * all_:
                some += all_ > 0 and both / all_ < 0.95
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in ids if find(i) == i), some


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    line = "this line stands in very many of the texts and is common".split()
    rows = []
    for base in range(50):
        words = rng.choices(vocabulary, k=rng.choice([6, 40, 120, 300])) + (line if base % 2 else [])
        rows.append(" ".join(words))
        rows += [" ".join(edited(rng, words, max(1, round(len(words) * share)))) for share in (0.005, 0.01, 0.015, 0.02, 0.023, 0.026, 0.03)]
        rows.append("  ".join(words).upper())
    rng.shuffle(rows)
    return [*enumerate(rows), (1000, None), (1001, " "), (1002, "two words"), (1003, "two words")]


@pytest.mark.parametrize("block", [256, 3])
def test_no_near_copy_is_lost(spark, planted, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    want, some = kept(planted)
    docs = spark.createDataFrame(planted, "doc_id long, text string").withColumn("node", F.lit("clash")).repartition(3)
    out = simhash.distinct(docs)
    assert some > 50 and out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == want
    assert simhash.distinct(docs.limit(0)).count() == 0


def test_pipeline_stage(spark, planted):
    """The stage as the pipeline runs it, which lost near copies when it linked fingerprints at 8 bits."""
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()) == kept(planted)[0]


def test_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in simhash.distinct(docs).collect()) == kept(rows)[0]
