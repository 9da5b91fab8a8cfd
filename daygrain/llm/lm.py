"""Language-model scores of whole texts by a log-bilinear model.

A token is a word or the end of a text. The most frequent words are classes of their own; other words share classes by their
last two bytes. The model predicts a token's class from the three before it, and a word within its class by its smoothed count:

    s(c1, c2, c3; w) = r[c1] C1 . q[w] + (r2[g(c2)] C2 + r3[g(c3)] C3) . q2[w] + b[w]

where g puts classes with similar vectors together. It is trained in numpy by noise-contrastive estimation, with the noise's expectation in place
of draws, in two rounds, each on a table that counts every token of all training texts: r, C1, q and b on the table of class pairs; then r2, C2, r3,
C3 and q2 on the table of what follows three groups. One text in eight is held back, by a hash of the text: a round ends where it
predicts those best, so that a small corpus isn't learnt by heart. Scores are normalised exactly: the sum over all classes after
every context is one product of two matrices of exponentials.

Counts cover every training text. Words whose counts fit a bound are sent to the executors; the counts of all other words
are joined to their tokens in Spark.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import held_out, mapped, ship, slices, staged, text_column

#: The token at a text's end; no word is empty.
END = b""
ADD = 0.1


@dataclass(frozen=True)
class Settings:
    """frequent: words at most whose counts executors hold. own, shared: classes of one word, classes that other words share. groups: of classes, one,
    two and three tokens before, on which the second round is trained; the first of them only there. noise: draws of it for a token seen.
    steps, rate: of the first round and of the second. patience: looks at the texts held back without a better one that end a round."""

    frequent: int = 1 << 18
    own: int = 896
    shared: int = 128
    groups: tuple[int, int, int] = (16, 16, 8)
    width: int = 48
    noise: float = 20.0
    steps: tuple[int, int] = (240, 120)
    rate: tuple[float, float] = (0.03, 0.02)
    look: int = 8
    patience: int = 3
    seed: int = 5

    @property
    def classes(self) -> int:
        return self.own + self.shared


def tokens(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of texts, one after another, and the number of each text's."""
    out: list[bytes] = []
    n = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.lower().split()
        out += words
        out.append(END)
        n[i] = len(words) + 1
    return out, n


def count(docs: DataFrame) -> DataFrame:
    """word, n over all texts (column text, bytes): counted within tasks first, so that a frequent word sends one row a task."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told():
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()

        for batch in batches:
            for some in slices(batch):
                seen.update(tokens(some.column("text").to_pylist())[0])
                if len(seen) > 400_000:
                    yield from told()
        yield from told()

    return docs.select("text").transform(mapped, local, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    """words: the frequent ones, by falling count, and their counts. total, distinct: of all training tokens. mass: log10 of what a shared
    class's words share, with room for one unseen word."""

    words: tuple[bytes, ...]
    n: np.ndarray
    total: int
    distinct: int
    mass: np.ndarray
    settings: Settings

    def shared_class(self, word: bytes) -> int:
        return self.settings.own + zlib.crc32(word[-2:]) % self.settings.shared

    def class_table(self) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
        """word -> place, and per place its class, log10(count + 0.1), and the log10 probability within its class."""
        own = min(self.settings.own, len(self.words))
        of = np.asarray([i if i < own else self.shared_class(w) for i, w in enumerate(self.words)], np.int32)
        log_n = np.log10(self.n + ADD)
        within = np.where(np.arange(len(of)) < own, 0.0, log_n - self.mass[np.maximum(of - self.settings.own, 0)])
        return dict(zip(self.words, range(len(self.words)), strict=True)), of, log_n, within


def vocabulary(counts: DataFrame, settings: Settings) -> tuple[Vocabulary, int]:
    """The frequent words, and the bin of counts that they begin at; by a histogram over all words, whose sums show that the bound holds."""
    size_bin = F.floor(F.log2("n") * 16).cast("int")
    bins = sorted(((r["bin"], r["words"], r["n"]) for r in counts.groupBy(size_bin.alias("bin")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).collect()), reverse=True)
    begin, held = 1 << 20, 0
    for b, words, _ in bins:
        if held + words > settings.frequent:
            break
        begin, held = b, held + words
    top = counts.where(size_bin >= begin).toArrow()
    order = sorted(zip(top.column("n").to_pylist(), top.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    words, n = tuple(w for _, w in order), np.asarray([c for c, _ in order], np.int64)
    own = set(words[: settings.own])
    in_class = (F.crc32(F.expr("substring(word, -2, 2)")) % settings.shared).alias("class")
    mine = np.zeros((settings.shared, 2))
    for r in counts.groupBy(in_class).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mine[r["class"]] = r["n"], r["v"]
    for w, c in zip(words, n.tolist(), strict=True):
        if w in own:
            mine[zlib.crc32(w[-2:]) % settings.shared] -= c, 1
    mass = np.log10(mine[:, 0] + ADD * (mine[:, 1] + 1))
    return Vocabulary(words, n, sum(b[2] for b in bins), sum(b[1] for b in bins), mass, settings), begin


class _Classes:
    """Places and classes of tokens, in a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.place, self.of, self.log_n, self.within = vocabulary.class_table()
        self.tails: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place or -1, class, which tokens have no place)."""
        get = self.place.get
        place = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        rare = np.flatnonzero(place < 0)
        cls = self.of[place] if len(self.of) else np.zeros(len(words), np.int32)
        tails = self.tails
        for i in rare.tolist():
            t = words[i][-2:]
            c = tails.get(t)
            if c is None:
                c = tails[t] = self.v.shared_class(t)
            cls[i] = c
        return place, cls, rare


def contexts(cls: np.ndarray, n: np.ndarray, end: int) -> list[np.ndarray]:
    """The classes one, two and three tokens before each token; before a text stand ends. n: tokens of each text."""
    at = np.arange(len(cls)) - np.repeat(np.cumsum(n) - n, n)
    out = []
    for k in (1, 2, 3):
        c = np.full(len(cls), end, np.int64)
        c[k:] = cls[:-k]
        out.append(np.where(at < k, end, c))
    return out


#: One text in so many is held back while the model is trained on the others.
HELD_BACK = 8


def gathered(docs: DataFrame, vocabulary: Vocabulary, group: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """[2, contexts, classes]: how often each class follows each context in all texts, those to train on and those held back. A context is the class before
    or, with groups of classes, the groups of the three before. At most as many rows come to the driver as the table has cells, 2**22 by default."""
    k = vocabulary.settings.classes
    sizes = [int(g.max()) + 1 for g in group]
    n_contexts = int(np.prod(sizes)) if group else k

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = _Classes(vocabulary), np.zeros(2 * n_contexts * k, np.int64)
        end = int(classes([END])[1][0])
        for batch in batches:
            for some in slices(batch):
                texts = some.column("text").to_pylist()
                words, n = tokens(texts)
                cls = classes(words)[1].astype(np.int64)
                before = contexts(cls, n, end)
                context = before[0]
                if group:
                    context = (group[0][before[0]] * sizes[1] + group[1][before[1]]) * sizes[2] + group[2][before[2]]
                back = np.repeat(np.asarray([zlib.crc32(t) % HELD_BACK == 0 for t in texts], np.int64), n)
                at, times = np.unique((back * n_contexts + context) * k + cls, return_counts=True)
                seen[at] += times
        cells = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int64()), "n": pa.array(seen[cells], pa.int64())})

    got = docs.select("text").transform(mapped, local, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * n_contexts * k, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(2, n_contexts, k)


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], keep: float):
        self.p, self.keep, self.step = p, keep, 0
        self.m, self.s = {x: np.zeros_like(v) for x, v in p.items()}, {x: np.zeros_like(v) for x, v in p.items()}

    def __call__(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        for x, v in grads.items():
            self.m[x] = 0.9 * self.m[x] + 0.1 * v
            self.s[x] = self.keep * self.s[x] + (1 - self.keep) * v * v
            self.p[x] -= rate * (self.m[x] / (1 - 0.9**self.step)) / (np.sqrt(self.s[x] / (1 - self.keep**self.step)) + 1e-9)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fitted(counts: np.ndarray, p: dict[str, np.ndarray], score, step, noise: np.ndarray, steps: int, rate: float, s: Settings) -> tuple[dict[str, np.ndarray], float]:
    """Parameters trained on counts[0] by noise-contrastive estimation, as they were when they predicted counts[1] best, and that log-likelihood a token.

    score(p): [contexts, classes]. step(p, g): the gradients of p, from that of the loss by the score. The noise is the classes' own
    distribution; for each token seen `noise` draws of it are contrasted, in expectation. Without held back tokens all steps are taken."""
    n, back = counts[0].astype(np.float32), counts[1].astype(np.float64)
    total, held = max(1.0, float(n.sum())), float(back.sum())
    data, context = n / total, (n.sum(1) / total).astype(np.float32)
    contrast = s.noise * context[:, None] * noise[None, :]
    shift = np.log(s.noise * noise)[None, :].astype(np.float32)
    move, best, found, tired = _Adam(p, 0.99), {x: v.copy() for x, v in p.items()}, -np.inf, 0
    for i in range(steps + 1):
        z = score(p)
        if held and (i % s.look == 0 or i == steps):
            top = z.max(1, keepdims=True)
            told = float((back * (z - top - np.log(np.exp(z - top).sum(1, keepdims=True)))).sum()) / held
            tired = 0 if told > found else tired + 1
            if told > found:
                best, found = {x: v.copy() for x, v in p.items()}, told
            if tired >= s.patience:
                break
        if i < steps:
            real = _sigmoid(z - shift)
            move(step(p, (data + contrast) * real - data), rate * min(1.0, 2 * (1 - i / (steps + 1))))
    return (best, found) if held else (p, found)


def train_pairs(counts: np.ndarray, settings: Settings) -> dict[str, np.ndarray]:
    """r, c, q, b of the token before alone."""
    k, d = settings.classes, settings.width
    rng = np.random.default_rng(settings.seed)
    q = _noise(counts[0])
    p = {"r": rng.normal(0, 0.1, (k, d)), "c": np.eye(d) + rng.normal(0, 0.01, (d, d)), "q": np.zeros((k, d)), "b": np.log(q)}
    p = {x: v.astype(np.float32) for x, v in p.items()}

    def step(p: dict, g: np.ndarray) -> dict[str, np.ndarray]:
        back, predicted = g @ p["q"], p["r"] @ p["c"]
        return {"r": back @ p["c"].T, "c": p["r"].T @ back, "q": g.T @ predicted, "b": g.sum(0)}

    return _fitted(counts, p, lambda p: p["r"] @ p["c"] @ p["q"].T + p["b"], step, q, settings.steps[0], settings.rate[0], settings)[0]


def refine(p: dict[str, np.ndarray], group: tuple[np.ndarray, ...], weight: np.ndarray, counts: np.ndarray, settings: Settings) -> dict[str, np.ndarray]:
    """p and r2, c2, r3, c3, q2, trained on the table of three groups, in which a group of the class before predicts what its classes do by their weight. They
    begin without a say, so that they have none where the texts held back don't ask for it."""
    d, sizes = settings.width, [int(g.max()) + 1 for g in group]
    mean = np.zeros((sizes[0], d))
    np.add.at(mean, group[0], (p["r"] @ p["c"]) * weight[:, None])
    mass = np.bincount(group[0], weights=weight, minlength=sizes[0])
    first = np.repeat((mean / np.maximum(mass, 1e-12)[:, None]).astype(np.float32) @ p["q"].T + p["b"], sizes[1] * sizes[2], 0)
    g2, g3 = np.tile(np.repeat(np.arange(sizes[1]), sizes[2]), sizes[0]), np.tile(np.arange(sizes[2]), sizes[0] * sizes[1])
    mine = {"r2": np.zeros((sizes[1], d), np.float32), "c2": np.eye(d, dtype=np.float32), "r3": np.zeros((sizes[2], d), np.float32), "c3": np.eye(d, dtype=np.float32)}
    mine["q2"] = p["q"] + np.random.default_rng(settings.seed + 9).normal(0, 0.1, p["q"].shape).astype(np.float32)

    def both(m: dict) -> np.ndarray:
        return (m["r2"] @ m["c2"])[g2] + (m["r3"] @ m["c3"])[g3]

    def score(m: dict) -> np.ndarray:
        return first + both(m) @ m["q2"].T

    def step(m: dict, g: np.ndarray) -> dict[str, np.ndarray]:
        back, out = g @ m["q2"], {"q2": g.T @ both(m)}
        for r, c, of in (("r2", "c2", g2), ("r3", "c3", g3)):
            sums = np.zeros((len(m[r]), d), np.float32)
            np.add.at(sums, of, back)
            out[r], out[c] = sums @ m[c].T, m[r].T @ sums
        return out

    return p | _fitted(counts, mine, score, step, _noise(counts[0]), settings.steps[1], settings.rate[1], settings)[0]


def _noise(pairs: np.ndarray) -> np.ndarray:
    """The classes' own distribution, none without a chance."""
    return ((pairs.sum(0) + 1.0) / (max(1.0, float(pairs.sum())) + len(pairs))).astype(np.float32)


def grouped(x: np.ndarray, groups: int, seed: int) -> np.ndarray:
    """A group for each row, by k-means."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(groups, len(x)), replace=False)]
    of = np.zeros(len(x), np.int64)
    for _ in range(15):
        of = ((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None]).argmin(1)
        centre = np.stack([x[of == i].mean(0) if (of == i).any() else centre[i] for i in range(len(centre))])
    return of


@dataclass(frozen=True)
class Tables:
    """Scores by class before and class, by group two and three before and class, and the log of the sum over all classes after each context."""

    group2: np.ndarray
    group3: np.ndarray
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray
    log_z: np.ndarray

    def log_p(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 of the probability of class w after c1, which follows c2, which follows c3."""
        g2, g3 = self.group2[c2], self.group3[c3]
        return (self.one[c1, w] + self.two[g2, w] + self.three[g3, w] - self.log_z[c1, g2 * len(self.three) + g3]) / np.log(10)


def train(pairs: np.ndarray, triples, settings: Settings) -> Tables:
    """The normalised model of class pairs and of triples(groups), the tables of gathered()."""
    p = train_pairs(pairs, settings)
    vectors = p["r"] @ p["c"]
    group = tuple(grouped(vectors, n, settings.seed + i) for i, n in enumerate(settings.groups))
    weight = pairs[0].sum(1).astype(np.float64)
    p = refine(p, group, weight, triples(group), settings)
    one, two, three = (p[r] @ p[c] @ p[q].T for r, c, q in (("r", "c", "q"), ("r2", "c2", "q2"), ("r3", "c3", "q2")))
    one = (one + p["b"]).astype(np.float64)
    both = (two[:, None] + three[None]).reshape(-1, settings.classes).astype(np.float64)
    top, top_both = one.max(1, keepdims=True), both.max(1, keepdims=True)
    with np.errstate(divide="ignore"):
        log_z = np.log(np.exp(one - top) @ np.exp(both - top_both).T) + top + top_both.T
    return Tables(group[1], group[2], *(x.astype(np.float32) for x in (one, two, three, log_z)))


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    tables: Tables
    counts: DataFrame  # of all words
    begin: int  # words in lower bins of counts aren't in the vocabulary


def fit(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", leave: Column | None = None) -> Model:
    """A model of the texts for which `leave` isn't true. Without any, every token is unseen."""
    ship(docs.sparkSession)
    known = (docs if leave is None else docs.where(~leave)).select(text_column(text_col).alias("text"))
    counts = staged(count(known), "counts")
    words, begin = vocabulary(counts, settings)
    return Model(words, train(gathered(known, words), lambda group: gathered(known, words, group), settings), counts, begin)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` (without `text_col`) and n_tokens, n_known, train_tokens, base_score, score; one row a row, repeated ones too.

    A null text is an end alone. Columns of `docs` with these names are replaced."""
    ship(docs.sparkSession)
    v = model.vocabulary
    told = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    rest = [c for c in docs.columns if c not in (*told, text_col)]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), text_column(text_col).alias("text"), F.struct(*rest, F.lit(0).alias("__")).alias("rest"))
    tables = model.tables

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(v)
        end = int(classes([END])[1][0])
        own = v.settings.own
        for batch in batches:
            for some in slices(batch):
                words, n = tokens(some.column("text").to_pylist())
                place, cls, rare = classes(words)
                common = place >= 0
                starts = np.cumsum(n) - n
                log_n = np.where(common, classes.log_n[place] if len(classes.log_n) else 0.0, 0.0)
                within = np.where(common, classes.within[place] if len(classes.within) else 0.0, -v.mass[np.maximum(cls - own, 0)])
                owner = np.searchsorted(starts, rare, side="right") - 1
                bounds = np.append(np.searchsorted(owner, np.arange(len(n))), len(rare))
                told = [sorted(Counter(words[i] for i in rare[a:b].tolist()).items()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                lists = pa.array([[{"word": w, "times": t} for w, t in x] for x in told], pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("row"), some.column("rest"), pa.array(n), pa.array(np.add.reduceat(common.astype(np.int64), starts)), pa.array(np.add.reduceat(log_n, starts)),
                        pa.array(np.add.reduceat(tables.log_p(*contexts(cls, n, end), cls).astype(np.float64) + within, starts)), lists,
                    ],
                    ["row", "rest", "n_tokens", "common", "log_n", "model", "rare"],
                )

    kind = numbered.schema["rest"].dataType.simpleString()
    rows = staged(numbered.transform(mapped, local, f"row long, rest {kind}, n_tokens long, common long, log_n double, model double, rare array<struct<word: binary, times: bigint>>"), "scores")
    others = model.counts.where(F.floor(F.log2("n") * 16).cast("int") < model.begin)
    asked = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    c = F.coalesce(F.col("n"), F.lit(0))
    found = asked.join(others, "word", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + ADD)).alias("log_rare"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known_rare"))
    out = rows.drop("rare").join(found, "row", "left")
    log_rare = F.coalesce(F.col("log_rare"), F.lit(0.0))
    whole = float(np.log10(v.total + ADD * (v.distinct + 1)))
    return out.select(
        *[F.col("rest")[x].alias(x) for x in rest],
        "n_tokens",
        (F.col("common") + F.coalesce(F.col("known_rare"), F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("log_n") + log_rare - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model") + log_rare).alias("score"),
    )


def predictions(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out and the scores of every document, by a model of those not held out."""
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id"), 10, 0).alias("held_out"))
    return scored(docs, fit(docs, settings, leave=F.col("held_out")))
