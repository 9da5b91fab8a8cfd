"""Opening hours: a subset of the public syntax of map tags.

`24/7`, or rules divided by semicolons, later ones overriding earlier: an optional list of days and ranges of days (which may wrap),
then `off`, `closed`, or a list of H:MM-H:MM, which may run past midnight. Rules for public or school holidays alone are skipped.
Anything else is not understood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of days, Monday first.
DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
_SPAN = re.compile(r"(\d{1,2}):(\d\d)\s*-\s*(\d{1,2}):(\d\d)")
_WEEK = [[(0, 1440)] for _ in DAYS]


def _days(text: str) -> list[int] | None:
    out: list[int] = []
    for part in (p.strip() for p in text.split(",")):
        ends = [e.strip() for e in part.split("-")]
        if any(e not in DAYS for e in ends) or len(ends) > 2:
            return None
        a, b = DAYS.index(ends[0]), DAYS.index(ends[-1])
        out += [(a + i) % 7 for i in range((b - a) % 7 + 1)]
    return out


def parse(text: str | None) -> list[list[tuple[int, int]]] | None:
    """Per day, Monday first, its spans in minutes (the end may pass 1440); None if not understood."""
    if text is None or not text.strip():
        return None
    if text.strip() == "24/7":
        return [list(d) for d in _WEEK]
    week: list[list[tuple[int, int]]] = [[] for _ in DAYS]
    seen = False
    for rule in filter(None, (r.strip() for r in text.split(";"))):
        if re.match(r"(PH|SH)\b", rule):
            if re.fullmatch(r"(PH|SH)(\s*,\s*(PH|SH))*\s+.*", rule):
                continue
            return None
        m = re.match(r"((?:Mo|Tu|We|Th|Fr|Sa|Su)[A-Za-z,\s-]*?)\s+(?=\d|off|closed)(.*)$", rule)
        days, rest = (_days(m[1]), m[2].strip()) if m else (list(range(7)), rule)
        if days is None:
            return None
        if rest in ("off", "closed"):
            spans: list[tuple[int, int]] = []
        else:
            spans = []
            for part in rest.split(","):
                t = _SPAN.fullmatch(part.strip())
                if not t:
                    return None
                a, b = int(t[1]) * 60 + int(t[2]), int(t[3]) * 60 + int(t[4])
                if a > 1440 or b > 1440 or int(t[2]) > 59 or int(t[4]) > 59:
                    return None
                spans.append((a, b if b > a else b + 1440))
        for d in days:
            week[d] = spans
        seen = True
    return week if seen else None


def parsed(text: Column) -> Column:
    """array of 7 arrays of struct<a, b>; null if not understood. Rows come in Arrow batches; distinct texts are parsed once a batch."""

    @F.arrow_udf("array<array<struct<a:int,b:int>>>")
    def of(chunks: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        for chunk in chunks:
            code = chunk.dictionary_encode()
            known = [w and [[{"a": a, "b": b} for a, b in d] for d in w] for w in map(parse, code.dictionary.to_pylist())]
            yield pa.array([None if i is None else known[i] for i in code.indices.to_pylist()], kind)

    return of(text)


def is_open(week: Column, local_minute: Column) -> Column:
    """Whether a week is open at a local minute (minutes of local time since the epoch); null for a null week."""
    day = F.pmod(F.floor(local_minute / 1440) + 3, F.lit(7)).cast("int")  # the epoch began on a Thursday
    at = F.pmod(local_minute, F.lit(1440))
    today, before = F.element_at(week, day + 1), F.element_at(week, F.pmod(day - 1, F.lit(7)) + 1)
    return F.when(week.isNotNull(), F.exists(today, lambda s: (at >= s["a"]) & (at < s["b"])) | F.exists(before, lambda s: at + 1440 < s["b"]))


def open_share(week: Column, start_s: Column, end_s: Column, shift_s: Column) -> Column:
    """The share of a stay's minutes [start, end) in which a week is open; null for a null week or a stay without a minute."""
    minutes = F.sequence(F.floor((start_s + shift_s) / 60), F.floor((end_s + shift_s - 1) / 60))
    n = F.aggregate(minutes, F.lit(0), lambda s, m: s + F.when(is_open(week, m), 1).otherwise(0))
    return F.when(week.isNotNull() & (end_s > start_s), n / F.size(minutes))
