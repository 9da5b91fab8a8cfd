"""Rides under ground, told by coarse fixes: a pass of the cascade.

Below ground a phone knows its place by cells alone, to 100 to 800 metres. A run of such fixes in a segment that isn't a stay votes for a line between the
station where good fixes end and the one where they begin again; where no line serves both, a change between two lines is looked for at the
places where the phone saw the sky. The segment is cut around what is found. Fixes are rows (t, lat, lon, accuracy, lines), `lines` being those within 300 m.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from operator import attrgetter
from typing import NamedTuple

import numpy as np

from daygrain.operators.passes import Day, Segment, still, tagged
from daygrain.operators.track import M_PER_DEGREE

#: Fixed values. Metres: accuracy of a coarse fix, and of one too coarse to vote; to a station; between the ends of a ride.
COARSE_M, MOST_COARSE_M, STATION_M, RIDE_M = 100.0, 800.0, 350.0, 800.0
#: Seconds: a run at least; a side that is kept; between coarse fixes of one run; over a change of trains; of good fixes that end a run.
RUN_S, SIDE_S, GAP_S, CHANGE_S, RECOVERY_S = 180, 60, 300, 1800, 30
#: A coarse fix between good ones is an error: within so many seconds and metres of both.
BLIP_S, BLIP_M = 120, 250.0
FIXES = 2


class Fix(NamedTuple):
    t: float
    lat: float
    lon: float
    accuracy: float | None
    lines: frozenset


class Ride(NamedTuple):
    line: str
    board: str
    alight: str
    start: float
    end: float


def metres(a, b) -> float:
    y, x = (b.lat - a.lat) * M_PER_DEGREE, (b.lon - a.lon) * M_PER_DEGREE * math.cos(math.radians(a.lat))
    return math.hypot(x, y)


def coarse(f: Fix) -> bool:
    return f.accuracy is not None and f.accuracy >= COARSE_M


def line_names(name: str) -> set[str]:
    """The lines that a name of a shared track stands for ('A, B and C Lines'), without a direction."""
    base = re.sub(r"\s+(?:East|West|North|South)bound$", "", name, flags=re.I).strip()
    parts = [p.strip() for p in re.split(r",\s*|\s+and\s+", base.removesuffix(" Lines"))] if base.endswith(" Lines") else []
    return {f"{p} Line" for p in parts if p} if len(parts) > 1 else {base}


def apart(names) -> set[str]:
    return set().union(*(line_names(n) for n in names))


def station_at(day: Day, at) -> dict | None:
    """The nearest station within 350 m, one of the underground (`subway`) before others."""
    near = [(not s.get("subway"), metres(at, Fix(0, s["lat"], s["lon"], None, frozenset())), s["name"], i) for i, s in enumerate(day.stations)]
    near = [x for x in near if x[1] <= STATION_M]
    return day.stations[min(near)[3]] if near else None


def _serves(s: dict, line: str) -> bool:
    """Whether the line stops there, as far as the station's lines are known."""
    return not s.get("lines") or bool(line_names(line) & apart(s["lines"]))


def ride(run: list[Fix], start, end, day: Day, shared: bool = False) -> Ride | None:
    """One ride on one line that passes both ends and most of the coarse fixes, between two stations that it serves; None if there is none. shared:
    names of shared tracks count as their lines."""
    votes = [f for f in run if coarse(f) and f.accuracy <= MOST_COARSE_M]
    if len(votes) < FIXES:
        return None
    read = apart if shared else set
    both = read(start.lines) & read(end.lines)
    count = Counter(n for f in votes for n in read(f.lines) if n in both)
    board, alight = station_at(day, start), station_at(day, end)
    if not count or not board or not alight or board["name"] == alight["name"] or metres(start, end) < RIDE_M:
        return None
    for line, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])):
        if _serves(board, line) and _serves(alight, line):
            return Ride(line, board["name"], alight["name"], votes[0].t, votes[-1].t)
    return None


def surfacings(fixes: list[Fix]) -> list[list[Fix]]:
    """Good fixes in order, in groups of one place: a group ends where time passes, or the way leads away from it."""
    out: list[list[Fix]] = []
    for f in fixes:
        if out and f.t - out[-1][-1].t <= GAP_S and metres(_centre(out[-1]), f) <= STATION_M:
            out[-1].append(f)
        else:
            out.append([f])
    return out


def _centre(some: list[Fix]) -> Fix:
    return Fix(some[len(some) // 2].t, float(np.mean([f.lat for f in some])), float(np.mean([f.lon for f in some])), None, frozenset().union(*(f.lines for f in some)))


def journey(run: list[Fix], good: list[Fix], start: Fix, end: Fix, day: Day) -> list[Ride]:
    """One ride; or two that meet at a station where the phone saw the sky, on lines of which neither serves the other's end; or, at last, one
    ride on a line that shared tracks name otherwise. Nothing if none of them fits."""
    one = ride(run, start, end, day)
    if one:
        return [one]
    votes = [f for f in run if coarse(f) and f.accuracy <= MOST_COARSE_M]
    if len(votes) < 2 * FIXES:
        return []
    for group in surfacings([f for f in good if votes[0].t < f.t < votes[-1].t]):
        at = _centre(group)
        first = ride([f for f in votes if f.t < at.t], start, at, day, True)
        second = ride([f for f in votes if f.t > at.t], at, end, day, True)
        if not first or not second or first.alight != second.board:
            continue
        a, b = line_names(first.line), line_names(second.line)
        if not a & b and not apart(start.lines) & b and not apart(end.lines) & a:
            return [first, second]
    last = ride(run, start, end, day, True)
    return [last] if last else []


_t = attrgetter("t")


def between(some: list[Fix], a: float, b: float) -> list[Fix]:
    """Those after a and before b, of fixes in order of time."""
    return some[bisect_right(some, a, key=_t) : bisect_left(some, b, key=_t)]


def before(some: list[Fix], t: float) -> Fix | None:
    """The last at t or before it."""
    i = bisect_right(some, t, key=_t)
    return some[i - 1] if i else None


def behind(some: list[Fix], t: float) -> Fix | None:
    """The first at t or behind it."""
    i = bisect_left(some, t, key=_t)
    return some[i] if i < len(some) else None


def dark_runs(some: list[Fix], good: list[Fix]) -> list[list[Fix]]:
    """Coarse fixes in runs: five minutes apart at most, or half an hour if they went on meanwhile and no good fixes tell of a journey between."""
    out: list[list[Fix]] = []
    for f in some:
        if out:
            last = out[-1][-1]
            gap = f.t - last.t
            seen = between(good, last.t, f.t) if GAP_S < gap <= CHANGE_S else []
            heard = any(metres(seen[0], g) > STATION_M for g in seen)
            if gap <= GAP_S or (gap <= CHANGE_S and not heard and metres(last, f) >= RIDE_M):
                out[-1].append(f)
                continue
        out.append([f])
    return out


def grown(run: list[Fix], dark: list[Fix], good: list[Fix]) -> list[Fix]:
    """A run with the coarse fixes around it, up to good ones that last, and without a last fix that good ones contradict."""
    lo = bisect_left(dark, run[0].t, key=_t)
    if lo == len(dark):
        return run
    hi = bisect_right(dark, run[-1].t, key=_t) - 1

    def near(a: Fix, b: Fix) -> bool:
        seen = between(good, a.t, b.t) if b.t - a.t <= GAP_S else []
        return b.t - a.t <= GAP_S and not (seen and seen[-1].t - seen[0].t >= RECOVERY_S)

    while lo > 0 and near(dark[lo - 1], dark[lo]):
        lo -= 1
    while hi < len(dark) - 1 and near(dark[hi], dark[hi + 1]):
        hi += 1
    out = dark[lo : hi + 1]
    while len(out) > 1 and _blip(out[-1], good) and metres(out[-2], out[-1]) > STATION_M:
        out = out[:-1]
    return out


def _blip(f: Fix, good: list[Fix]) -> bool:
    i, j = bisect_left(good, f.t, key=_t), bisect_right(good, f.t, key=_t)
    around = (good[i - 1] if i else None, good[j] if j < len(good) else None)
    return all(g is not None and abs(g.t - f.t) <= BLIP_S and metres(f, g) <= BLIP_M for g in around)


def underground_rail(segments: list[Segment], day: Day) -> list[Segment]:
    """Rides under ground cut out of the segments that took them in: what was before, one or two rides with the change between them, what came after."""
    if "lines" not in day.fixes:
        return segments
    if all(_settled(s) for s in segments):
        return segments
    order = day.order.tolist()
    told = (list(day.fixes[c]) for c in ("t", "lat", "lon", "accuracy", "lines"))
    rows = list(zip(*told, strict=True))
    fixes = [Fix(float(t), float(y), float(x), None if a is None or a != a else float(a), frozenset(n if n is not None else ())) for t, y, x, a, n in (rows[i] for i in order)]
    good, dark = [f for f in fixes if not coarse(f)], [f for f in fixes if coarse(f)]
    out = []
    for s in segments:
        pieces = [] if _settled(s) else _carved(s, good, dark, day)
        out += pieces or [s]
    return out


def _settled(s: Segment) -> bool:
    """A stay, or a ride whose stations are known."""
    return still(s) or bool(s["mode"] == "train" and s.get("board") and s.get("alight"))


def _carved(s: Segment, good: list[Fix], dark: list[Fix], day: Day) -> list[Segment]:
    span = lambda r: r[-1].t - r[0].t
    runs = [r for r in dark_runs(dark[bisect_left(dark, s["start_ts"], key=_t) : bisect_right(dark, s["end_ts"], key=_t)], good) if len(r) >= FIXES and span(r) >= RUN_S]
    if not runs:
        return []
    run = grown(max(runs, key=lambda r: (span(r), -r[0].t)), dark, good)
    if len(run) < FIXES or span(run) < RUN_S:
        return []
    start, end = before(good, run[0].t), behind(good, run[-1].t)
    rides = journey(run, between(good, run[0].t, run[-1].t), start, end, day) if start and end else []
    if not rides:
        return []
    a, b = max(s["start_ts"], start.t), min(s["end_ts"], end.t)
    head, tail = a - s["start_ts"] >= SIDE_S, s["end_ts"] - b >= SIDE_S
    a, b = (a if head else s["start_ts"]), (b if tail else s["end_ts"])
    kmh = round(metres(start, end) / max(1.0, b - a) * 3.6, 1)
    share = lambda x, y: int((s.get("points") or 0) * (y - x) / max(1, s["end_ts"] - s["start_ts"]))
    side = lambda x, y: {**s, "start_ts": x, "end_ts": y, "points": share(x, y), "way_name": None}
    out = [side(s["start_ts"], a)] if head else []
    at = a
    for i, r in enumerate(rides):
        stop, go = b, None
        if i + 1 < len(rides):
            x, y = r.end, rides[i + 1].start
            stop, go = (x, y) if y - x >= SIDE_S else (round((x + y) / 2), None)
        told = {"mode": "train", "board": r.board, "alight": r.alight, "line": r.line, "confidence": 0.6, "confidence_margin": 1.5, "avg_speed": kmh, "linearity": 1.0, "points": 0, "place": None, "city": None, "way_name": None}
        out.append(tagged({**s, **told, "start_ts": at, "end_ts": stop}, "underground"))
        if go is not None:
            out.append(tagged(side(stop, go), "underground_change"))
        at = stop if go is None else go
    return [*out, side(b, s["end_ts"])] if tail else out
