"""Secret scans by a trigram inverted index.

Each rule's regular expression is parsed and turned into a Boolean query over trigrams that every match must hold. The
documents of a block (a slice of a partition) are indexed on the trigrams that any query names, postings are united and
intersected as bitmaps, and the regular expression verifies only the documents that remain. A rule from which no
mandatory trigram follows scans every document. Nothing is shuffled; the memory of a block is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.llm.common import give_back, held, ship, slices

#: A set of exact strings larger than this is no longer multiplied out.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind: the name that spans carry. least: characters that group `group` of a match has at least; a shorter match is dropped after it was found."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The rules whose spans a digest of base spans is made of, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Well-known shapes of keys that the base rules don't name.
EXTRA = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + EXTRA

# A query is None (every document), a trigram, or ("and" | "or", (queries...)).


def _join(op: str, parts: list):
    """An empty `or` can't happen; an `and` drops what holds everywhere, an `or` with such a part holds everywhere."""
    if op == "or" and any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _of_strings(strings: set[str]):
    """The query of 'one of these strings occurs', on lower-cased text."""
    each = [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]
    return _join("or", each) if each else None


def _members(items) -> set[str] | None:
    """The characters of a class, if few."""
    out: set[str] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            out.add(chr(arg).lower())
        elif op is rc.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tree) -> tuple[set[str] | None, object]:
    """(the exact strings that the part can match, if few; the query that each of its matches meets)."""
    known: set[str] | None = {""}
    needs: list = []

    def flush() -> None:
        nonlocal known
        if known is not None:
            needs.append(_of_strings(known))
        known = {""}

    for op, arg in tree:
        strings: set[str] | None = None
        query = None
        if op is rc.LITERAL:
            strings = {chr(arg).lower()}
        elif op is rc.IN:
            strings = _members(arg)
        elif op is rc.SUBPATTERN:
            strings, query = _walk(arg[3])
        elif op is rc.BRANCH:
            both = [_walk(x) for x in arg[1]]
            strings = set().union(*(s for s, _ in both)) if all(s is not None for s, _ in both) else None
            query = _join("or", [q if s is None else _join("and", [q, _of_strings(s)]) for s, q in both])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, within = _walk(body)
            if low == 0:
                strings = inner | {""} if high == 1 and inner is not None else None
            else:
                query = within if inner is None else _join("and", [within, _of_strings(inner)])
                if inner is not None and high == low and len(inner) ** min(low, 8) <= MOST_STRINGS:
                    strings = {""}
                    for _ in range(low):
                        strings = {a + b for a in strings for b in inner}
        elif op is rc.AT:
            continue
        needs.append(query)
        if strings is not None and known is not None and len(known) * len(strings) <= MOST_STRINGS:
            known = {a + b for a in known for b in strings}
        else:
            flush()
            known = strings if strings is not None else {""}
            if strings is None:
                needs.append(None)
                known = {""}
    exact = known if not any(n is not None for n in needs) and _bounded(tree) else None
    if exact is None:
        flush()
    return exact, _join("and", needs)


def _bounded(tree) -> bool:
    """Whether the strings that _walk() put together are whole matches."""
    for op, arg in tree:
        if op is rc.LITERAL or op is rc.AT:
            continue
        if op is rc.IN and _members(arg) is not None:
            continue
        if op is rc.SUBPATTERN and _bounded(arg[3]):
            continue
        if op is rc.BRANCH and all(_bounded(x) for x in arg[1]):
            continue
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] == 1 and _bounded(arg[2]):
            continue
        return False
    return True


def trigram_query(pattern: str):
    """The Boolean query over lower-cased trigrams that each text with a match of `pattern` meets; None: all texts do."""
    exact, query = _walk(rp.parse(pattern))
    return _join("and", [query, _of_strings(exact)]) if exact is not None else query


def _trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _eval(query, postings: dict[str, np.ndarray]) -> np.ndarray:
    if isinstance(query, str):
        return postings[query]
    parts = [_eval(q, postings) for q in query[1]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def _plan(rules: tuple[Rule, ...]):
    return held(f"secrets {hash(rules)}", lambda: _made(rules))


def _made(rules: tuple[Rule, ...]):
    """Per rule its query, and a table from the 24 bits of a trigram to its place among those that any query names (0: none)."""
    queries = [trigram_query(r.pattern) for r in rules]
    # A trigram with a character beyond ASCII isn't indexed: such a rule scans fully.
    queries = [None if any(not t.isascii() for t in _trigrams(q)) else q for q in queries]
    names = sorted(set().union(*map(_trigrams, queries)))
    lut = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
    for i, t in enumerate(names):
        a, b, c = t.encode()
        lut[a << 16 | b << 8 | c] = i + 1
    return queries, names, lut, [r.compiled() for r in rules]


def candidates(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[np.ndarray]:
    """Per rule, whether each text of a block can match: postings of the block's index, united and intersected."""
    queries, names, lut, _ = _plan(rules)
    block = np.frombuffer(b"\xff\xff".join(texts).lower() + b"\xff\xff", np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts])
    code = block[:-2].astype(np.uint32)
    code <<= 8
    code |= block[1:-1]
    code <<= 8
    code |= block[2:]
    ids = lut[code]
    at = np.flatnonzero(ids)
    held = np.zeros((len(names) + 1, len(texts)), bool)
    held[ids[at], np.searchsorted(ends, at, side="right")] = True
    postings = {t: held[i + 1] for i, t in enumerate(names)}
    return [np.ones(len(texts), bool) if q is None else _eval(q, postings) for q in queries]


def find(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, end, place of the rule), ordered by start, then by the rules' order. Offsets are code points."""
    patterns = _plan(rules)[3]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    decoded: dict[int, str] = {}
    for k, (rule, pattern, hits) in enumerate(zip(rules, patterns, candidates(texts, rules), strict=True)):
        for i in np.flatnonzero(hits).tolist():
            if i not in decoded:
                decoded[i] = texts[i].decode(errors="replace")
            for m in pattern.finditer(decoded[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), m.end(), k))
    for spans in out:
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind, start, end>> of the secrets in a text; a null or empty text has none. Ends are exclusive, offsets code points."""

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def scan(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in chunks:
            rows = []
            for part in slices(pa.record_batch([chunk], ["text"])):
                for one in find([t or b"" for t in part.column(0).to_pylist()], rules):
                    rows.append([{"kind": rules[k].kind, "start": a, "end": b} for a, b, k in one])
            yield pa.array(rows, pa.list_(SPAN))
        give_back()

    return scan(F.coalesce(text, F.lit("")).cast("binary"))


def redacted(text: Column, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> Column:
    """A text that has secrets with each maximal run of overlapping spans replaced by `mark`; null for any other. Bytes that aren't UTF-8 become
    U+FFFD in texts that are changed."""

    @F.arrow_udf("string")
    def cut(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chunk in chunks:
            out: list[str | None] = []
            for part in slices(pa.record_batch([chunk], ["text"])):
                texts = part.column(0).to_pylist()
                for t, spans_ in zip(texts, find(texts, rules), strict=True):
                    out.append(_without(t.decode(errors="replace"), spans_, mark) if spans_ else None)
            yield pa.array(out, pa.string())
        give_back()

    return cut(F.coalesce(text, F.lit("")).cast("binary"))


def _without(text: str, spans_: list[tuple[int, int, int]], mark: str) -> str:
    parts, at, i = [], 0, 0
    while i < len(spans_):
        start, end, _ = spans_[i]
        while i < len(spans_) and (spans_[i][0] < end or spans_[i][0] == start):
            end = max(end, spans_[i][1])
            i += 1
        parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with a column of spans (see spans()); every row stays, repeated ones too, and other columns are left alone.

    An input column named `out_col` is replaced. An empty table gives an empty table."""
    ship(docs.sparkSession)
    return docs.withColumn(out_col, spans(F.col(text_col), rules))


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]", length_col: str | None = None) -> DataFrame:
    """`docs` with secrets in the text replaced by `mark`; clean texts, nulls included, stay as they are. `length_col`, if any, is set to the new length."""
    ship(docs.sparkSession)
    new = "__new"
    while new in docs.columns:
        new += "_"
    out = docs.withColumn(new, redacted(F.col(text_col), rules, mark))
    changed = F.col(new).isNotNull()
    if length_col:
        out = out.withColumn(length_col, F.when(changed, F.length(new).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.withColumn(text_col, F.coalesce(new, text_col)).drop(new)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts and digests of its spans, from scan()."""
    base = [r.kind for r in BASE]
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))

    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")
    def told(rows: pa.Array) -> pa.Array:
        out = []
        for ss in rows.to_pylist():
            mine = [s for s in ss if s["kind"] in base]
            say = lambda xs: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in xs)
            out.append({f"n_{k}": sum(s["kind"] == k for s in mine) for k in base} | {"base_sha256": hashlib.sha256(say(mine).encode()).hexdigest(), "spans": say(ss)})
        return pa.array(out, pa.struct([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]))

    return found.select("doc_id", told("secret_spans").alias("d")).select("doc_id", "d.*")
