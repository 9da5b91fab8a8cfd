"""The refinement cascade: passes over a day's segments, in an order that matters, as one kernel a user's day.

A segment is a dict: start_ts, end_ts, mode, and, where known, place, avg_speed, linearity, points, steps, peak_cadence, walking_minutes, extent_m, lat, lon,
board, alight, line, way_name, city, kinds. A pass takes a list of segments, ordered by time, and a Day with what it may look up, and gives a new list.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrain.cluster import staged
from daygrain.functions import geo
from daygrain.operators import groups
from daygrain.operators.track import R_M, core_displacement, haversine, incoherent_stay

Segment = dict
VEHICLES = ("driving", "train", "bus", "cycling", "plane", "vehicle", "boat")


class Track:
    """Fixes in order of time: t, lat, lon; kmh and hop (metres) from each to the next. A part shares the arrays of the whole."""

    __slots__ = ("t", "lat", "lon", "kmh", "hop")

    def __init__(self, t: np.ndarray, lat: np.ndarray, lon: np.ndarray, kmh: np.ndarray | None = None, hop: np.ndarray | None = None):
        self.t, self.lat, self.lon = t, lat, lon
        self.hop = (haversine(lat[:-1], lon[:-1], lat[1:], lon[1:]) if len(t) > 1 else np.zeros(0)) if hop is None else hop
        self.kmh = (self.hop / np.maximum(np.diff(t), 1) * 3.6 if len(t) > 1 else np.zeros(0)) if kmh is None else kmh

    def __len__(self) -> int:
        return len(self.t)

    def part(self, i: int, j: int) -> Track:
        k = max(i, j - 1)
        return Track(self.t[i:j], self.lat[i:j], self.lon[i:j], self.kmh[i:k], self.hop[i:k])


class Samples:
    """Values in order of time, found by bisection; one that is null counts nothing."""

    def __init__(self, t, value):
        t, value = np.asarray(t, float), np.asarray(value, float)
        known = ~np.isnan(value)
        order = np.argsort(t[known], kind="stable")
        self.t, self.value = t[known][order], value[known][order]
        self._t = self.t.tolist()

    def since(self, a: float, b: float) -> slice:
        """Those from a on and before b."""
        return slice(bisect_left(self._t, a), bisect_left(self._t, b))

    def inside(self, a: float, b: float) -> np.ndarray:
        """Values between a and b, both left out."""
        return self.value[bisect_right(self._t, a) : bisect_left(self._t, b)]

    def over(self, a: float, b: float) -> np.ndarray:
        """Values from a to b, both taken in."""
        return self.value[bisect_left(self._t, a) : bisect_right(self._t, b)]


@dataclass
class Day:
    """Columns of fixes: t, lat, lon, speed_kmh and, for rides under ground, accuracy and lines (those near). steps: t, steps a minute. heart: t, bpm. stations: name, lat, lon, lines.
    focus: place -> (lat, lon). Each is put in order of time once, and a segment's rows are found by bisection."""

    fixes: pd.DataFrame | Mapping = field(default_factory=lambda: pd.DataFrame(columns=["t", "lat", "lon", "speed_kmh"]))
    steps: pd.DataFrame | Mapping = field(default_factory=lambda: pd.DataFrame(columns=["t", "steps"]))
    heart: pd.DataFrame | Mapping = field(default_factory=lambda: pd.DataFrame(columns=["t", "bpm"]))
    stations: list[dict] = field(default_factory=list)
    focus: dict = field(default_factory=dict)

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(np.asarray(self.fixes["t"], float), kind="stable")

    @cached_property
    def seen(self) -> Track:
        return Track(*(np.asarray(self.fixes[c], float)[self.order] for c in ("t", "lat", "lon")))

    @cached_property
    def _times(self) -> list[float]:
        return self.seen.t.tolist()

    @cached_property
    def walked(self) -> Samples:
        return Samples(self.steps["t"], self.steps["steps"])

    @cached_property
    def beats(self) -> Samples:
        return Samples(self.heart["t"], self.heart["bpm"])

    @cached_property
    def _at(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([s["lat"] for s in self.stations], float), np.array([s["lon"] for s in self.stations], float)

    def track(self, a: float, b: float) -> Track:
        return self.seen.part(bisect_left(self._times, a), bisect_right(self._times, b))

    def count(self, a: float, b: float) -> int:
        """Fixes from a on and before b."""
        return bisect_left(self._times, b) - bisect_left(self._times, a)

    def step_sum(self, a: float, b: float) -> float:
        return float(self.walked.value[self.walked.since(a, b)].sum())

    def brisk(self, a: float, b: float) -> np.ndarray:
        """When, from a on and before b, 60 steps a minute or more were taken."""
        at = self.walked.since(a, b)
        return self.walked.t[at][self.walked.value[at] >= 60]

    def station_near(self, lat: float | None, lon: float | None, radius_m: float) -> dict | None:
        if lat is None or not self.stations:
            return None
        d = haversine(lat, lon, *self._at)
        k = int(np.argmin(d))
        return self.stations[k] if d[k] <= radius_m else None


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """haversine() of two points."""
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((math.radians(lon2) - math.radians(lon1)) / 2) ** 2
    return 2 * R_M * math.asin(math.sqrt(min(1.0, a)))


def length(s: Segment) -> float:
    return s["end_ts"] - s["start_ts"]


def tagged(s: Segment, kind: str) -> Segment:
    kinds = s.get("kinds") or []
    return {**s, "kinds": kinds if kind in kinds else [*kinds, kind]}


def still(s: Segment) -> bool:
    return s["mode"] == "stationary"


def _apart(a: Segment, b: Segment) -> float:
    if any(x.get(k) is None for x in (a, b) for k in ("lat", "lon")):
        return float("inf")
    return metres(a["lat"], a["lon"], b["lat"], b["lon"])


def joined(a: Segment, b: Segment) -> Segment:
    """One segment for two: figures weighted by points, the mode and labels of the first, what is unknown there from the second."""
    n, m = a.get("points") or 0, b.get("points") or 0
    out = {**{k: v for k, v in b.items() if v is not None}, **{k: v for k, v in a.items() if v is not None}, "end_ts": max(a["end_ts"], b["end_ts"]), "points": n + m}
    for k, digits in (("avg_speed", 1), ("linearity", 2), ("confidence", 2), ("confidence_margin", 2), ("lat", 9), ("lon", 9)):
        if a.get(k) is not None and b.get(k) is not None:
            out[k] = round((a[k] * n + b[k] * m) / (n + m), digits) if n + m else a[k]
    for k in ("steps", "walking_minutes"):
        if a.get(k) is not None or b.get(k) is not None:
            out[k] = (a.get(k) or 0) + (b.get(k) or 0)
    if a.get("peak_cadence") is not None or b.get("peak_cadence") is not None:
        out["peak_cadence"] = max(a.get("peak_cadence") or 0, b.get("peak_cadence") or 0)
    return out


def stationary_coherence(segments: list[Segment], day: Day) -> list[Segment]:
    """A 'stay' that goes straight and far is a walk."""
    out = []
    for s in segments:
        if still(s):
            f = day.track(s["start_ts"], s["end_ts"])
            d = core_displacement(f.t, f.lat, f.lon, kmh=f.kmh)
            if incoherent_stay(length(s), s.get("linearity") or 0.0, d, d / max(1.0, length(s)) * 3.6):
                s = tagged({**s, "mode": "walking", "place": None}, "incoherent_stay")
        out.append(s)
    return out


def merge_stays(segments: list[Segment], day: Day, gap_s: float = 300) -> list[Segment]:
    """Stays at one place, at most five minutes apart, are one; so are those around a short slow move, or around a gap without a fix."""
    out: list[Segment] = []
    for s in segments:
        if still(s) and s.get("place") is not None and out:
            last = out[-1]
            if still(last) and last.get("place") == s["place"] and s["start_ts"] - last["end_ts"] <= gap_s:
                out[-1] = joined(last, s)
                continue
            if len(out) > 1 and still(out[-2]) and out[-2].get("place") == s["place"]:
                cadence = day.step_sum(last["start_ts"], last["end_ts"]) / (length(last) / 60) if length(last) > 0 else 0.0
                slow = not still(last) and length(last) <= 600 and (last.get("avg_speed") or 0) <= 2 and cadence < 20
                blind = last["mode"] == "unknown" and not last.get("points")
                if slow or blind:
                    out.pop()
                    out[-1] = joined(out[-1], s)
                    continue
        out.append(s)
    return out


def way_label(parts: list[tuple[str, float]]) -> str | None:
    """Names by falling share of the time, those with 15 % or more, three at most, while they fit in 30 characters."""
    total, each = sum(d for _, d in parts), {}
    for name, d in parts:
        each[name] = each.get(name, 0) + d
    out = ""
    for name, d in sorted(each.items(), key=lambda x: (-x[1], x[0]))[:3]:
        longer = f"{out}, {name}" if out else name
        if d < 0.15 * total or (out and len(longer) > 30):
            break
        out = longer
    return out or None


def merge_moving(segments: list[Segment], day: Day, gap_s: float = 180) -> list[Segment]:
    """Moves of one mode, at most three minutes apart and not in different cities, are one."""
    out: list[Segment] = []
    for s in segments:
        if out and not still(s) and out[-1]["mode"] == s["mode"] and s["start_ts"] - out[-1]["end_ts"] <= gap_s:
            a = out[-1]
            if not (a.get("city") and s.get("city") and a["city"] != s["city"]):
                parts = [*(a.get("way_parts") or [(a.get("way_name"), length(a))]), (s.get("way_name"), length(s))]
                m = joined(a, s)
                m["way_parts"] = [p for p in parts if p[0]]
                m["way_name"] = way_label(m["way_parts"]) if m["way_parts"] else None
                m["city"] = a.get("city") if a.get("city") == s.get("city") else None
                out[-1] = m
                continue
        out.append(s)
    return out


def consolidate_jitter(segments: list[Segment], day: Day, near_m: float = 75) -> list[Segment]:
    """Neighbouring stays within 75 m of each other are one."""
    out: list[Segment] = []
    for s in segments:
        if out and still(s) and still(out[-1]) and _apart(out[-1], s) <= near_m:
            a = out[-1]
            out[-1] = {**joined(a, s), "place": (a if length(a) >= length(s) else s).get("place") or a.get("place") or s.get("place")}
            continue
        out.append(s)
    return out


def split_reversals(segments: list[Segment], day: Day, far_m: float = 1500) -> list[Segment]:
    """A ride that doubles back, 1.5 km or more on both sides, is two rides, cut at the farthest fix."""
    out = []
    for s in segments:
        f = day.track(s["start_ts"], s["end_ts"]) if s["mode"] in VEHICLES else ()
        if len(f) < 3:
            out.append(s)
            continue
        t, y, x = f.t, f.lat, f.lon
        d = haversine(y[0], x[0], y, x)
        k = int(d.argmax())
        k_x = np.cos(np.radians(y[k]))
        a, b = np.array([(x[k] - x[0]) * k_x, y[k] - y[0]]), np.array([(x[-1] - x[k]) * k_x, y[-1] - y[k]])
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        if 0 < k < len(t) - 1 and norm > 0 and a @ b / norm < -0.5 and d[k] >= far_m and haversine(y[k], x[k], y[-1], x[-1]) >= far_m:
            n = s.get("points") or len(t)
            out += [tagged({**s, "end_ts": t[k], "points": int(n * k / len(t))}, "turnaround"), tagged({**s, "start_ts": t[k], "points": n - int(n * k / len(t)), "board": None, "alight": None, "line": None}, "turnaround_board")]
        else:
            out.append(s)
    return out


def _lines(*stations: dict | None) -> set:
    return set.intersection(*(set(s.get("lines") or ()) for s in stations)) if all(stations) else set()


def rail_runs(segments: list[Segment], day: Day, near_m: float = 400) -> list[Segment]:
    """Trains take the names of the stations at their ends, and the line that both share, if it is one."""
    out = []
    for s in segments:
        f = day.track(s["start_ts"] - 120, s["end_ts"] + 120) if s["mode"] == "train" and not s.get("board") else ()
        if len(f) > 1:
            a, b = (day.station_near(f.lat[i], f.lon[i], near_m) for i in (0, -1))
            if a and b and a["name"] != b["name"]:
                common = _lines(a, b)
                s = tagged({**s, "board": a["name"], "alight": b["name"], "line": s.get("line") or (next(iter(common)) if len(common) == 1 else None)}, "rail_run")
        out.append(s)
    return out


def revert_cadence(segments: list[Segment], day: Day) -> list[Segment]:
    """A walk that was taken for a drive, slower than 7 km/h and without a real ride beside it (stays and other such drives are skipped), is a walk."""
    def ride(i: int, step: int) -> bool:
        i += step
        while 0 <= i < len(segments) and (still(segments[i]) or segments[i].get("flipped")):
            i += step
        return 0 <= i < len(segments) and segments[i]["mode"] in VEHICLES

    return [{**s, "mode": "walking", "flipped": False} if s.get("flipped") and (s.get("avg_speed") or 0) < 7 and not ride(i, -1) and not ride(i, 1) else s for i, s in enumerate(segments)]


def boarding_platform(segments: list[Segment], day: Day) -> list[Segment]:
    """A wait of 15 minutes or less at the station where the next train is boarded belongs to the train."""
    out: list[Segment] = []
    for s in segments:
        if out and s["mode"] == "train" and s.get("board") and still(out[-1]) and length(out[-1]) <= 900:
            at = day.station_near(out[-1].get("lat"), out[-1].get("lon"), 400)
            if at and at["name"] == s["board"]:
                s = tagged({**s, "start_ts": out.pop()["start_ts"]}, "platform")
        out.append(s)
    return out


def interchanges(segments: list[Segment], day: Day) -> list[Segment]:
    """Stays of eight minutes or less each, after a train and before a move, belong to the train."""
    out, i = [], 0
    while i < len(segments):
        s, j = segments[i], i + 1
        if s["mode"] == "train":
            while j < len(segments) and still(segments[j]) and length(segments[j]) <= 480:
                j += 1
            if i + 1 < j < len(segments) and not still(segments[j]):
                s = tagged({**s, "end_ts": segments[j - 1]["end_ts"]}, "interchange")
            else:
                j = i + 1
        out.append(s)
        i = j
    return out


def drive_stops(segments: list[Segment], day: Day) -> list[Segment]:
    """A stop of 15 minutes or less with five steps or fewer, between two drives, belongs to the drive."""
    for _ in range(10):
        out, i = [], 0
        while i < len(segments):
            s = segments[i]
            if s["mode"] == "driving" and i + 2 < len(segments) and still(segments[i + 1]) and segments[i + 2]["mode"] == "driving" and length(segments[i + 1]) <= 900 and (segments[i + 1].get("steps") or 0) <= 5:
                s = joined({**s, "end_ts": segments[i + 1]["end_ts"]}, segments[i + 2])
                i += 2
            out.append(s)
            i += 1
        if len(out) == len(segments):
            return out
        segments = out
    return segments


def rail_reconcile(segments: list[Segment], day: Day) -> list[Segment]:
    """Trains that follow each other share a station: the second boards where the first alights; two with one end are one."""
    out: list[Segment] = []
    for s in segments:
        a = out[-1] if out else None
        if a and a["mode"] == s["mode"] == "train" and a.get("alight") and s.get("board") and a["alight"] != s["board"]:
            if a["alight"] == s.get("alight"):
                out[-1] = {**a, "end_ts": s["end_ts"]}
                continue
            s = tagged({**s, "board": a["alight"]}, "reconciled")
        out.append(s)
    return out


def merge_same_route(segments: list[Segment], day: Day) -> list[Segment]:
    """Trains between one pair of stations, at most three minutes apart, are one; the label that has a line stays."""
    out: list[Segment] = []
    for s in segments:
        a = out[-1] if out else None
        if a and a["mode"] == s["mode"] == "train" and a.get("board") and (a["board"], a.get("alight")) == (s.get("board"), s.get("alight")) and s["start_ts"] - a["end_ts"] <= 180:
            out[-1] = {**joined(a, s), "line": a.get("line") or s.get("line")}
            continue
        out.append(s)
    return out


def walk_through(segments: list[Segment], day: Day) -> list[Segment]:
    """Stays with a burst of steps and movement are walks; walks that then touch are one."""
    out: list[Segment] = []
    for i, s in enumerate(segments):
        if still(s) and 180 <= length(s) <= 2700 and (s.get("avg_speed") or 0) >= 1 and ((s.get("peak_cadence") or 0) >= 80 or (s.get("walking_minutes") or 0) >= 3):
            settled = length(s) >= 600 and (s.get("extent_m") if s.get("extent_m") is not None else 1e9) <= 80
            a, b = (segments[j] if 0 <= j < len(segments) else None for j in (i - 1, i + 1))
            inside = a and b and still(a) and still(b) and a.get("place") is not None and a.get("place") == b.get("place")
            if not settled and not inside:
                s = tagged({**s, "mode": "walking", "place": None}, "walk_through")
        if out and s["mode"] == out[-1]["mode"] == "walking" and s["start_ts"] - out[-1]["end_ts"] <= 180:
            out[-1] = joined(out[-1], s)
            continue
        out.append(s)
    return out


def interchange_label(segments: list[Segment], day: Day) -> list[Segment]:
    """A walk of five minutes or less between trains that meet at one station has its name."""
    out = list(segments)
    for i in range(1, len(out) - 1):
        a, s, b = out[i - 1], out[i], out[i + 1]
        if s["mode"] == "walking" and length(s) <= 300 and a["mode"] == b["mode"] == "train" and a.get("alight") and a["alight"] == b.get("board"):
            out[i] = tagged({**s, "place": a["alight"]}, "interchange_walk")
    return out


def _pace(day: Day, a: float, b: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    f = day.track(a, b)
    return f.t, f.lat, f.lon, f.kmh


def vehicle_split(segments: list[Segment], day: Day) -> list[Segment]:
    """A run at 15 km/h or more inside a walk, of 400 m and two minutes with a peak of 20, is a ride of its own."""
    out: list[Segment] = []
    for s in segments:
        if s["mode"] != "walking":
            out.append(s)
            continue
        t, y, x, v = _pace(day, s["start_ts"], s["end_ts"])
        ride = None
        if len(v) and v.max() >= 15:
            on = np.flatnonzero(np.diff(np.concatenate([[0], (v >= 15).astype(int), [0]])))
            for a, b in on.reshape(-1, 2).tolist():
                if t[b] - t[a] >= 120 and metres(y[a], x[a], y[b], x[b]) >= 400 and v[a:b].max() >= 20 and (ride is None or t[b] - t[a] > ride[1] - ride[0]):
                    ride = t[a], t[b]
        if ride is None:
            out.append(s)
            continue
        kmh = float(np.median(v[(t[:-1] >= ride[0]) & (t[:-1] < ride[1])]))
        parts = [{**s, "end_ts": ride[0]}, tagged({**s, "start_ts": ride[0], "end_ts": ride[1], "mode": "driving", "avg_speed": round(kmh, 1), "steps": None}, "vehicle_leg"), {**s, "start_ts": ride[1]}]
        out += [p for p in parts if length(p) > 0]
    return out


def walk_tail_to_vehicle(segments: list[Segment], day: Day) -> list[Segment]:
    """The end of a walk at a vehicle's pace belongs to the ride that follows."""
    out = [dict(s) for s in segments]
    for a, b in zip(out, out[1:], strict=False):
        if a["mode"] == "walking" and b["mode"] in VEHICLES:
            t, _, _, v = _pace(day, a["start_ts"], a["end_ts"])
            k = len(v)
            while k and v[k - 1] >= 15:
                k -= 1
            if k < len(v) and t[-1] - t[k] >= 30:
                a["end_ts"] = b["start_ts"] = t[k]
    return [s for s in out if length(s) > 0]


def vehicle_arrival(segments: list[Segment], day: Day) -> list[Segment]:
    """A short walk between a drive and a stay that has no steps is part of both: it goes with the drive up to the last fast fix, then with the stay."""
    out, i = [], 0
    while i < len(segments):
        s = segments[i]
        if 0 < i < len(segments) - 1 and s["mode"] == "walking" and out and out[-1]["mode"] == "driving" and still(segments[i + 1]) and length(s) <= 600 and s.get("steps") is not None and s["steps"] <= 5:
            t, _, _, v = _pace(day, s["start_ts"], s["end_ts"])
            fast = np.flatnonzero(v >= 7)
            cut = t[fast[-1] + 1] if len(fast) else s["start_ts"]
            out[-1] = {**out[-1], "end_ts": cut}
            out.append(tagged({**segments[i + 1], "start_ts": cut}, "arrival"))
            i += 2
            continue
        out.append(s)
        i += 1
    return out


def shed_pedestrian_edges(segments: list[Segment], day: Day) -> list[Segment]:
    """The slow end of a train, with steps, belongs to the walk beside it."""
    out = [dict(s) for s in segments]
    for a, b in zip(out, out[1:], strict=False):
        if a["mode"] == "train" and b["mode"] == "walking":
            t, _, _, v = _pace(day, a["start_ts"], a["end_ts"])
            k = len(v)
            while k and v[k - 1] < 7:
                k -= 1
            if k < len(v) and t[-1] - t[k] >= 60 and day.step_sum(t[k], t[-1]) >= 40 * (t[-1] - t[k]) / 60:
                a["end_ts"] = b["start_ts"] = t[k]
        elif a["mode"] == "walking" and b["mode"] == "train":
            t, _, _, v = _pace(day, b["start_ts"], b["end_ts"])
            k = 0
            while k < len(v) and v[k] < 7:
                k += 1
            if k and t[k] - t[0] >= 60 and day.step_sum(t[0], t[k]) >= 40 * (t[k] - t[0]) / 60:
                a["end_ts"] = b["start_ts"] = t[k]
    return [s for s in out if length(s) > 0]


def ride_head_claim(segments: list[Segment], day: Day) -> list[Segment]:
    """Steps at the end of a stay, away from it, before a ride: a walk of its own."""
    out: list[Segment] = []
    for i, s in enumerate(segments):
        if still(s) and i + 1 < len(segments) and segments[i + 1]["mode"] in VEHICLES:
            t, y, x, v = _pace(day, s["start_ts"], s["end_ts"])
            k = len(v)
            while k and 2 <= v[k - 1] < 15:
                k -= 1
            if k < len(v) and t[-1] - t[k] >= 120 and metres(y[k], x[k], y[-1], x[-1]) >= 100 and day.step_sum(t[k], t[-1]) >= 40 * (t[-1] - t[k]) / 60:
                out += [{**s, "end_ts": t[k]}, tagged({**s, "start_ts": t[k], "end_ts": s["end_ts"], "mode": "walking", "place": None}, "departure_walk")]
                continue
        out.append(s)
    return [s for s in out if length(s) > 0]


def stay_arrival_claim(segments: list[Segment], day: Day) -> list[Segment]:
    """A walk that ends standing at the next stay ends where it stood."""
    out = [dict(s) for s in segments]
    for a, b in zip(out, out[1:], strict=False):
        if a["mode"] == "walking" and still(b) and b.get("lat") is not None:
            t, y, x, v = _pace(day, a["start_ts"], a["end_ts"])
            k = len(v)
            while k and v[k - 1] < 1.5 and metres(y[k - 1], x[k - 1], b["lat"], b["lon"]) <= 75:
                k -= 1
            if k < len(v) and t[-1] - t[k] >= 120:
                a["end_ts"] = b["start_ts"] = t[k]
    return [s for s in out if length(s) > 0]


def boarding_anchor(segments: list[Segment], day: Day) -> list[Segment]:
    """A train boards at the station that the walk before it reached."""
    out = [dict(s) for s in segments]
    for a, b in zip(out, out[1:], strict=False):
        if a["mode"] == "walking" and b["mode"] == "train" and b.get("alight"):
            f = day.track(a["start_ts"], a["end_ts"])
            at = day.station_near(f.lat[-1], f.lon[-1], 250) if len(f) else None
            if at and at["name"] not in (b.get("board"), b["alight"]) and (not b.get("line") or b["line"] in (at.get("lines") or ())):
                b["board"] = at["name"]
    return out


def alight_anchor(segments: list[Segment], day: Day) -> list[Segment]:
    """A train alights at the station where the walk after it begins."""
    out = [dict(s) for s in segments]
    for a, b in zip(out, out[1:], strict=False):
        if a["mode"] == "train" and b["mode"] == "walking" and a.get("board"):
            f = day.track(b["start_ts"], b["end_ts"])
            at = day.station_near(f.lat[0], f.lon[0], 250) if len(f) else None
            if at and at["name"] not in (a.get("alight"), a["board"]) and (not a.get("line") or a["line"] in (at.get("lines") or ())):
                a["alight"] = at["name"]
    return out


def rail_journey(segments: list[Segment], day: Day) -> list[Segment]:
    """Fragments of a ride on one line, each boarding where the one before alights, with less than five minutes between, are one ride."""
    out: list[Segment] = []
    for s in segments:
        a = out[-1] if out else None
        if a and a["mode"] == s["mode"] == "train" and a.get("line") and a["line"] == s.get("line") and a.get("alight") == s.get("board") and a.get("board") != s.get("alight") and s["start_ts"] - a["end_ts"] <= 300:
            out[-1] = tagged({**joined(a, s), "board": a["board"], "alight": s.get("alight")}, "journey")
            continue
        out.append(s)
    return out


def tube_hop(segments: list[Segment], day: Day) -> list[Segment]:
    """A drive from station to station with no train beside it, at 28 km/h or with a blackout hop, on a line that both share, is a train."""
    out = []
    for i, s in enumerate(segments):
        beside = any(0 <= j < len(segments) and segments[j]["mode"] == "train" for j in (i - 1, i + 1))
        f = day.track(s["start_ts"] - 60, s["end_ts"] + 60) if s["mode"] == "driving" and not beside else ()
        if len(f) > 1:
            y, x, v, hop = f.lat, f.lon, f.kmh, f.hop
            k, net = int(hop.argmax()), metres(y[0], x[0], y[-1], x[-1])
            others = np.delete(v, k)
            blackout = net > 0 and hop[k] >= 0.6 * net and v[k] >= 25 and (not len(others) or np.median(others) <= 8)
            a, b = day.station_near(y[0], x[0], 250), day.station_near(y[-1], x[-1], 250)
            common = _lines(a, b)
            if ((s.get("avg_speed") or 0) >= 28 or blackout) and a and b and a["name"] != b["name"] and common:
                s = tagged({**s, "mode": "train", "board": a["name"], "alight": b["name"], "line": next(iter(common)) if len(common) == 1 else None}, "tube_hop")
        out.append(s)
    return out


def interchange_split(segments: list[Segment], day: Day) -> list[Segment]:
    """A single train ride between stations without a common line is two, where a burst of steps tells a change."""
    names = {s["name"]: s for s in day.stations}
    out = []
    for s in segments:
        a, b = names.get(s.get("board")), names.get(s.get("alight"))
        if s["mode"] == "train" and a and b and not _lines(a, b):
            m = day.brisk(s["start_ts"] + 120, s["end_ts"] - 120)
            f = day.track(m[0] - 120, m[-1] + 180) if len(m) else ()
            at = day.station_near(np.nanmedian(f.lat), np.nanmedian(f.lon), 400) if len(f) else None
            if at and _lines(a, at) and _lines(at, b):
                one, two = _lines(a, at), _lines(at, b)
                pick = lambda lines: next(iter(lines)) if len(lines) == 1 else None
                t1, t2 = float(m[0]), float(m[-1] + 60)
                out += [tagged({**s, "end_ts": t1, "alight": at["name"], "line": pick(one)}, "change"), {**s, "start_ts": t1, "end_ts": t2, "mode": "walking", "place": at["name"], "board": None, "alight": None, "line": None}, tagged({**s, "start_ts": t2, "board": at["name"], "line": pick(two)}, "change")]
                continue
        out.append(s)
    return out


def ride_tail_trim(segments: list[Segment], day: Day) -> list[Segment]:
    """A train ends at the station where it alights: what comes behind it, slow and with steps, is a walk."""
    names = {s["name"]: s for s in day.stations}
    out: list[Segment] = []
    for i, s in enumerate(segments):
        at = names.get(s.get("alight"))
        after = segments[i + 1] if i + 1 < len(segments) else None
        if s["mode"] == "train" and at and not (after and after["mode"] == "train"):
            t, y, x, v = _pace(day, s["start_ts"], s["end_ts"])
            near = np.flatnonzero(haversine(y, x, at["lat"], at["lon"]) <= 250) if len(t) else []
            if len(near) and t[-1] - t[near[-1]] >= 120 and (v[near[-1] :] < 10).all() and day.step_sum(t[near[-1]], t[-1]) >= 40 * (t[-1] - t[near[-1]]) / 60:
                out += [{**s, "end_ts": t[near[-1]]}, tagged({**s, "start_ts": t[near[-1]], "mode": "walking", "board": None, "alight": None, "line": None}, "tail")]
                continue
        out.append(s)
    return out


def absorb_intra_place_walk(segments: list[Segment], day: Day) -> list[Segment]:
    """A walk of 12 minutes or less between two stays at one place, 75 m apart at most, that keeps within 120 m of the first, is part of the stay."""
    out = [dict(s) for s in segments]
    for a, s, b in zip(out, out[1:], out[2:], strict=False):
        if s["mode"] == "walking" and length(s) <= 720 and still(a) and still(b) and a.get("place") is not None and a.get("place") == b.get("place") and _apart(a, b) <= 75:
            f = day.track(s["start_ts"], s["end_ts"])
            if not len(f) or haversine(a["lat"], a["lon"], f.lat, f.lon).max() <= 120:
                s.update(mode="stationary", place=a["place"], lat=a["lat"], lon=a["lon"])
    return out


def far_focus_phantom(segments: list[Segment], day: Day) -> list[Segment]:
    """A stay 120 m or more from the centre of its own place, while another stay at that place is within 90 m of the centre and none lies between, is a walk."""
    out = [dict(s) for s in segments]
    stays = [i for i, s in enumerate(out) if still(s)]
    for n, i in enumerate(stays):
        centre = day.focus.get(out[i].get("place"))
        if centre is None or out[i].get("lat") is None or metres(out[i]["lat"], out[i]["lon"], *centre) < 120:
            continue
        for m in (n - 1, n + 1):
            o = out[stays[m]] if 0 <= m < len(stays) else None
            if o and o.get("place") == out[i].get("place") and o.get("lat") is not None and metres(o["lat"], o["lon"], *centre) <= 90:
                out[i].update(mode="walking", place=None)
                break
    return out


def final_merge(segments: list[Segment], day: Day) -> list[Segment]:
    return merge_moving(merge_stays(far_focus_phantom(absorb_intra_place_walk(segments, day), day), day), day)


def repair_handoff(segments: list[Segment], day: Day) -> list[Segment]:
    """A vehicle leg within two minutes of a train that is known, itself unknown and not the way back, belongs to the train."""
    out: list[Segment] = []
    for s in segments:
        a = out[-1] if out else None
        if a and a["mode"] in VEHICLES and s["mode"] in VEHICLES and s["start_ts"] - a["end_ts"] <= 120 and "turnaround_board" not in (s.get("kinds") or []):
            known = [x["mode"] == "train" and bool(x.get("board")) for x in (a, s)]
            if known == [True, False]:
                out[-1] = tagged({**a, "end_ts": s["end_ts"]}, "handoff")
                continue
            if known == [False, True]:
                out[-1] = tagged({**s, "start_ts": a["start_ts"]}, "handoff")
                continue
        out.append(s)
    return out


def changeover(segments: list[Segment], day: Day) -> list[Segment]:
    """Between two trains that touch, a stretch with steps of a minute or more is a walk."""
    out: list[Segment] = []
    for s in segments:
        a = out[-1] if out else None
        if a and a["mode"] == s["mode"] == "train" and a.get("alight") and a["alight"] == s.get("board") and s["start_ts"] - a["end_ts"] <= 60:
            m = day.brisk(a["end_ts"] - 300, s["start_ts"] + 300)
            if len(m) >= 1 and m[0] > a["start_ts"] and m[-1] + 60 < s["end_ts"]:
                t1, t2 = float(m[0]), float(m[-1] + 60)
                out[-1] = {**a, "end_ts": t1}
                out.append(tagged({"start_ts": t1, "end_ts": t2, "mode": "walking", "place": a["alight"], "points": 0}, "changeover"))
                s = {**s, "start_ts": t2}
        out.append(s)
    return out


def interchange_stay_label(segments: list[Segment], day: Day) -> list[Segment]:
    """A stay between trains at one station, or without a name where a train alights, has the station's name."""
    out = [dict(s) for s in segments]
    for i in range(1, len(out)):
        a, s, b = out[i - 1], out[i], out[i + 1] if i + 1 < len(out) else None
        if still(s) and s.get("place") is None and a["mode"] == "train" and a.get("alight"):
            at = day.station_near(s.get("lat"), s.get("lon"), 250)
            if (b and b["mode"] == "train" and b.get("board") == a["alight"]) or (at and at["name"] == a["alight"]):
                out[i] = tagged({**s, "place": a["alight"]}, "station_stay")
    return out


def vehicle_identity(segments: list[Segment], day: Day) -> list[Segment]:
    """The last ride of a day, still under way: a drive that nothing names is just a vehicle."""
    if segments and segments[-1]["mode"] == "driving" and not any(segments[-1].get(k) for k in ("matched_path", "way_name", "vehicle_kind")):
        return [*segments[:-1], tagged({**segments[-1], "mode": "vehicle"}, "unidentified")]
    return list(segments)


#: The passes that need no map beyond stations, in their order.
CASCADE: tuple[Callable[[list[Segment], Day], list[Segment]], ...] = (
    stationary_coherence, merge_stays, merge_moving, consolidate_jitter, split_reversals, rail_runs, revert_cadence, boarding_platform, interchanges, drive_stops, rail_reconcile, merge_same_route,
    interchange_split, ride_tail_trim, walk_through, interchange_label, vehicle_split, walk_tail_to_vehicle, vehicle_arrival, shed_pedestrian_edges, ride_head_claim, stay_arrival_claim, boarding_anchor,
    alight_anchor, rail_journey, tube_hop, final_merge, repair_handoff, rail_reconcile, changeover, interchange_stay_label, vehicle_identity,
)


def run(segments: list[Segment], day: Day, passes: tuple = CASCADE) -> list[Segment]:
    for p in passes:
        segments = p(segments, day)
    return segments


TEXT, NUMBER = ("board", "alight", "line", "way_name"), ("avg_speed", "linearity", "confidence", "confidence_margin", "lat", "lon", "steps", "peak_cadence", "walking_minutes", "extent_m")


def with_underground(passes: tuple = CASCADE) -> tuple:
    """The cascade with rides under ground put behind rail runs."""
    from daygrain.operators.underground import underground_rail

    i = passes.index(rail_runs) + 1
    return (*passes[:i], underground_rail, *passes[i:])


def lines_near(fixes: DataFrame, keys: list[str], rails: DataFrame, radius_m: float = 300.0) -> DataFrame:
    """Fixes (keys, t, lat, lon, ...) with `lines`: the lines of rails (line, lat1, lon1, lat2, lon2) within the radius of each, none if there is none.

    Rails are written first, so that Spark knows which side is the small one: of rows made here it takes the fixes for it, and all of them then meet the
    rails in the rails' few tasks."""
    from daygrain.operators.joins import edge_cells

    at = [*keys, "t", "lat", "lon"]
    p, e = edge_cells(fixes.select(*at), staged(rails.select("line", "lat1", "lon1", "lat2", "lon2"), "rails"), radius_m, max(geo.band_size(radius_m), 0.002))
    # Told in a column, not in a filter: Spark would put that into the join, where it computes each part of the distance anew wherever it is used.
    near = p.join(e, ["__cy", "__cx"]).withColumn("__m", geo.to_segment(*map(F.col, ("lat", "lon", "lat1", "lon1", "lat2", "lon2"))))
    told = near.groupBy(*at).agg(F.array_sort(F.collect_set(F.when(F.col("__m") <= radius_m, F.col("line")))).alias("lines"))  # the lines of one place
    return fixes.join(told, at, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))


def cascade(segments: DataFrame, fixes: DataFrame, steps: DataFrame, keys: list[str], stations: list[dict] = (), passes: tuple | None = None, focus: DataFrame | None = None, rails: DataFrame | None = None, heart: DataFrame | None = None) -> DataFrame:
    """Refined segments of each group (a user's day): start_ts, end_ts, mode, place, figures, labels, kinds. Days without segments give no row.

    The inputs meet by key in one shuffle: a day's rows, not a table's, many days a batch. stations: those of the region, a list that the caller bounds. focus: keys, place,
    lat, lon of the places that a user goes to. rails: line, lat1, lon1, lat2, lon2 of railways, with which rides under ground are told where the fixes have an
    accuracy. heart: keys, t, bpm, with which segments are cut and joined on evidence first. passes: all of these and the cascade if None. Where places
    are numbers, a pass that names a station as one leaves none."""
    if passes is None:
        from daygrain.operators.evidence import with_evidence

        passes = CASCADE if rails is None else with_underground()
        passes = passes if heart is None else with_evidence(passes)
    below = rails is not None and "accuracy" in fixes.columns
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    place = kinds.get("place", "string")
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", start_ts long, end_ts long, mode string, place {place}, points long, " + ", ".join([*(f"{c} double" for c in NUMBER), *(f"{c} string" for c in TEXT)]) + ", kinds array<string>"
    stations = list(stations)
    columns = {"t": "long", "lat": "double", "lon": "double", "speed_kmh": "double", "steps": "double", "bpm": "double", "focus": place}
    seen = ["t", "lat", "lon", "speed_kmh"]
    if below:
        fixes, seen = lines_near(fixes, keys, rails), [*seen, "accuracy", "lines"]
        columns |= {"accuracy": "double", "lines": "array<string>"}
    told = [c for c in segments.columns if c not in keys]

    def side(d: DataFrame, n: int, **told: Column) -> DataFrame:
        return d.select(*keys, F.lit(n).alias("__side"), *[told.get(c, F.lit(None)).cast(k).alias(c) for c, k in columns.items()])

    rows = segments.select(*keys, F.lit(SEGMENT).alias("__side"), F.col("start_ts").alias("t"), F.struct(*told).alias("__s"))
    rows = rows.unionByName(side(fixes, FIX, **{c: F.col(c) for c in seen}), allowMissingColumns=True)
    rows = rows.unionByName(side(steps, STEPS, t=F.col("t"), steps=F.col("steps")), allowMissingColumns=True)
    if heart is not None:
        rows = rows.unionByName(side(heart, HEART, t=F.col("t"), bpm=F.col("bpm")), allowMissingColumns=True)
    if focus is not None:
        rows = rows.unionByName(side(focus, FOCUS, lat=F.col("lat"), lon=F.col("lon"), focus=F.col("place")), allowMissingColumns=True)
    names = [*keys, "start_ts", "end_ts", "mode", "place", "points", *NUMBER, *TEXT, "kinds"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in groups.whole(batches, keys):
            sides = table.column("__side").to_numpy()
            seg = table.column("__s").combine_chunks()
            number = {c: table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("t", "lat", "lon", "speed_kmh", "steps", "bpm", *(["accuracy"] if below else []))}
            out, at = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                cut = (lo + np.searchsorted(sides[lo:hi], range(FOCUS + 2))).tolist()
                if cut[FIX] == lo:
                    continue
                part = lambda n, *some, cut=cut: {c: number[c][cut[n] : cut[n + 1]] for c in some}
                f = part(FIX, *(c for c in seen if c != "lines"))
                if below:
                    f["lines"] = table.column("lines").slice(cut[FIX], cut[FIX + 1] - cut[FIX]).to_pylist()
                places = table.column("focus").slice(cut[FOCUS], hi - cut[FOCUS]).to_pylist()
                known = dict(zip(places, zip(*part(FOCUS, "lat", "lon").values(), strict=True), strict=True))
                day = Day(f, part(STEPS, "t", "steps"), part(HEART, "t", "bpm"), stations, known)
                found = run([{k: None if v != v else v for k, v in s.items()} for s in seg.slice(lo, cut[FIX] - lo).to_pylist()], day, passes)
                out += found
                at += [lo] * len(found)
            if out:
                yield from _told([table.column(k).take(pa.array(at)) for k in keys], out, names, place).to_batches()

    order = [*keys, "__side", "t", "__s.end_ts", "__s.mode", "lat", "lon", "steps", "bpm"]
    return groups.dealt(rows, keys).sortWithinPartitions(*order).mapInArrow(work, schema)


#: What a row that goes to a day's kernel tells, in the order in which they come.
SEGMENT, FIX, STEPS, HEART, FOCUS = range(5)


def _told(keys: list, found: list[Segment], names: list[str], place: str) -> pa.Table:
    """Segments as columns, keys first."""
    numbers = place in ("bigint", "int")
    whole = lambda c: pa.array([round(s[c]) for s in found], pa.int64())
    known = lambda v: None if v is None or v != v else v
    of = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    a_place = pa.array([None if numbers and isinstance(v, str) else int(v) if numbers and v is not None else v for v in (known(s.get("place")) for s in found)], of[place])
    real = [pa.array([None if (v := known(s.get(c))) is None else float(v) for s in found], pa.float64()) for c in NUMBER]
    text = [pa.array([known(s.get(c)) for s in found], pa.string()) for c in TEXT]
    kinds = pa.array([k if isinstance(k := s.get("kinds"), list) else [] for s in found], pa.list_(pa.string()))
    points = pa.array([int(known(s.get("points")) or 0) for s in found], pa.int64())
    return pa.table([*keys, whole("start_ts"), whole("end_ts"), pa.array([s["mode"] for s in found], pa.string()), a_place, points, *real, *text, kinds], names=names)
