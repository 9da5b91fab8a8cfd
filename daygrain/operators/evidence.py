"""Steps, heart and gaps as evidence for where a segment should be cut or joined, before the cascade.

A gap in the fixes of a stay is weighed in nats: steps in it, how long it is beside the gaps before, heart rate, and where the next fix lies. Scores of all gaps
of a table are joins and windows; cutting a stay is a recursion (a cut begins a new run, whose gaps and centre count from there), so it is
a pass over a day's segments, as are the other two.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import geo
from daygrain.operators.joins import in_interval
from daygrain.operators.passes import CASCADE, Day, Segment, metres, still, tagged

#: Fixed values. Seconds of a gap that is weighed, and nats from which it cuts.
GAP_S, CUT_NATS = 900, 2.5
#: Nats by steps a minute in the gap (above each bound; the last below all), by the gap's length as a multiple of the median before it, and by heart rate.
BY_STEPS, NO_STEPS = ((20.0, 3.5), (8.0, 2.0), (3.0, 0.5), (1.0, -0.5)), -2.0
BY_LENGTH, LEAST_FIXES = ((50.0, 1.0), (10.0, 0.5)), 5
BY_HEART, CALM, LEAST_BEATS = ((110.0, 0.8), (95.0, 0.3)), (75.0, -0.5), 3
#: Metres of the next fix from the run's centre that speak for one stay, and their nats.
SAME_M, SAME = 20.0, -0.5
#: A sit in a walk: seconds of the walk, of the sit and of the walk that is left; steps a minute of a sit at most, of a walk's onset and core; its minutes of onset.
WALK_S, SIT_S, CORE_S, SIT_STEPS, ONSET_STEPS, CORE_STEPS, ONSET_MIN, FRESH_S = 1200, 900, 180, 5.0, 10.0, 40.0, 6, 1800
#: Stays that are joined: metres and seconds apart, beats in the gap and their mean at most, mean over both where there is no gap.
JOIN_M, JOIN_S, JOIN_BEATS, REST_BPM, BOTH_BPM = 150.0, 600, 3, 90.0, 130.0


def _banded(x: Column, bands: tuple, below: float) -> Column:
    out = F.lit(below)
    for bound, nats in reversed(bands):
        out = F.when(x > bound, nats).otherwise(out)
    return out


def split_score(gap_s: Column, median_gap_s: Column, fixes: Column, steps: Column, beats: Column, bpm: Column, away_m: Column) -> Column:
    """Nats for a departure in a gap. median_gap_s: of the gaps before it in its run (null or 0: none); fixes: of the run so far; beats, bpm: number and mean in the
    gap; away_m: of the next fix from the run's centre. 0 for no gap."""
    moved = _banded(steps / (gap_s / 60), BY_STEPS, NO_STEPS)
    ratio = gap_s / F.when(median_gap_s > 0, median_gap_s)
    longer = F.when((fixes >= LEAST_FIXES) & (moved > 0), F.coalesce(_banded(ratio, BY_LENGTH, 0.0), F.lit(0.0))).otherwise(0.0)
    heart = F.when((beats >= LEAST_BEATS) & bpm.isNotNull(), F.when(bpm > BY_HEART[0][0], BY_HEART[0][1]).when(bpm > BY_HEART[1][0], BY_HEART[1][1]).when(bpm < CALM[0], CALM[1]).otherwise(0.0)).otherwise(0.0)
    same = F.when(away_m < SAME_M, SAME).otherwise(0.0)
    return F.when(gap_s > 0, moved + longer + heart + same).otherwise(0.0)


def score(gap_s: float, gaps: list[float], fixes: int, steps: float, bpm: np.ndarray, away_m: float) -> float:
    """The same for one gap; gaps: those before it in its run."""
    if gap_s <= 0:
        return 0.0
    out = next((n for bound, n in BY_STEPS if steps / (gap_s / 60) > bound), NO_STEPS)
    median = float(np.median(gaps)) if gaps and fixes >= LEAST_FIXES and out > 0 else 0.0
    if median > 0:
        out += next((n for bound, n in BY_LENGTH if gap_s / median > bound), 0.0)
    if len(bpm) >= LEAST_BEATS:
        mean = float(np.mean(bpm))
        out += next((n for bound, n in BY_HEART if mean > bound), CALM[1] if mean < CALM[0] else 0.0)
    return out + (SAME if away_m < SAME_M else 0.0)


def gap_scores(fixes: DataFrame, steps: DataFrame, heart: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The gaps of each key's fixes (t, lat, lon), taken as one run, with their evidence: keys, start_ts, end_ts, gap_s, median_gap_s, fixes, steps, beats, bpm, away_m, nats.

    steps: keys, t, steps; heart: keys, t, bpm; those between both fixes, neither included, count. A key is a user's day or a stay."""
    w = Window.partitionBy(*keys).orderBy("t", tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.col("t") - F.lag("t").over(w)
    rows = fixes.withColumn("gap_s", gap).withColumn("start_ts", F.lag("t").over(w)).withColumn("fixes", F.row_number().over(w) - 1)
    rows = rows.withColumn("__lat", F.avg("lat").over(before)).withColumn("__lon", F.avg("lon").over(before)).withColumn("median_gap_s", F.percentile("gap_s", 0.5).over(before))
    away = geo.haversine(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon"))
    gaps = rows.where(F.col("gap_s") >= GAP_S).select(*keys, "start_ts", F.col("t").alias("end_ts"), "gap_s", "median_gap_s", "fixes", away.alias("away_m"))
    key = [*keys, "start_ts", "end_ts"]

    def within(samples: DataFrame, *told: Column) -> DataFrame:
        inside = in_interval(samples, gaps.select(*key), keys).where((F.col("t") > F.col("start_ts")) & (F.col("t") < F.col("end_ts")))
        return inside.groupBy(*key).agg(*told)

    s = within(steps.select(*keys, "t", "steps"), F.sum("steps").alias("steps"))
    h = within(heart.select(*keys, "t", "bpm"), F.count("bpm").alias("beats"), F.avg("bpm").alias("bpm"))
    out = gaps.join(s, key, "left").join(h, key, "left").withColumn("steps", F.coalesce("steps", F.lit(0))).withColumn("beats", F.coalesce("beats", F.lit(0)))
    return out.withColumn("nats", split_score(*(F.col(c) for c in ("gap_s", "median_gap_s", "fixes", "steps", "beats", "bpm", "away_m"))))


def split_stays(segments: list[Segment], day: Day) -> list[Segment]:
    """A stay is cut at gaps of 15 minutes or more in its fixes that 2.5 nats of evidence tell to be a departure; between its parts nothing is known."""
    out = []
    for s in segments:
        f = day.track(s["start_ts"], s["end_ts"]) if still(s) else ()
        if len(f) < 2:
            out.append(s)
            continue
        t, (y, x) = f.t.tolist(), (np.append(0.0, np.cumsum(c)).tolist() for c in (f.lat, f.lon))  # sums, of which each run's centre comes
        runs, gaps, a = [], [], 0
        for i in range(1, len(t)):
            gap = t[i] - t[i - 1]
            if gap >= GAP_S:
                away = metres((y[i] - y[a]) / (i - a), (x[i] - x[a]) / (i - a), f.lat[i], f.lon[i])
                if score(gap, gaps, i - a, day.walked.inside(t[i - 1], t[i]).sum(), day.beats.inside(t[i - 1], t[i]), away) > CUT_NATS:
                    runs.append((a, i))
                    a, gaps = i, []
                    continue
            gaps.append(gap)
        runs.append((a, len(t)))
        if len(runs) == 1:
            out.append(s)
            continue
        for k, (i, j) in enumerate(runs):
            out.append(tagged({**s, "start_ts": t[i], "end_ts": t[j - 1], "points": j - i}, "stay_split"))
            if k + 1 < len(runs):
                out.append({"start_ts": t[j - 1], "end_ts": t[runs[k + 1][0]], "mode": "unknown", "confidence": 0.1, "confidence_margin": 1.0, "avg_speed": 0.0, "linearity": 0.0, "points": 0, "kinds": ["departure_gap"]})
    return out


def split_walks(segments: list[Segment], day: Day) -> list[Segment]:
    """A walk of 20 minutes or more that begins or ends with a quarter of an hour almost without steps is a sit and a walk, if what is left is walked indeed."""
    out = []
    for s in segments:
        a, b = s["start_ts"], s["end_ts"]
        if s["mode"] != "walking" or b - a < WALK_S or not len(day.walked.over(a, b + FRESH_S)):
            out.append(s)
            continue
        total = int(np.ceil((b - a) / 60))
        on = day.walked.since(a, a + 60 * total)
        cadence = np.bincount(np.floor((day.walked.t[on] - a) / 60).astype(int), weights=day.walked.value[on], minlength=total)
        cum = np.append(0, np.cumsum(cadence))
        mean = lambda i, j, cum=cum: (cum[j] - cum[i]) / (j - i) if j > i else 0.0
        sit = -(-SIT_S // 60)
        onset = np.flatnonzero(cadence >= ONSET_STEPS).tolist()
        head = next((i for i in onset if i >= sit and mean(i, min(total, i + ONSET_MIN)) >= CORE_STEPS and mean(0, i) <= SIT_STEPS), 0)
        tail = next((total - i for i in (k + 1 for k in reversed(onset)) if head < i <= total - sit and mean(max(0, i - ONSET_MIN), i) >= CORE_STEPS and mean(i, total) <= SIT_STEPS), 0)
        x, y = a + 60 * head, min(b, a + 60 * (total - tail))
        if not (head or tail) or y - x < CORE_S or mean(head, total - tail) < CORE_STEPS:
            out.append(s)
            continue
        sat = lambda i, j: tagged({**s, "mode": "stationary", "start_ts": i, "end_ts": j, "avg_speed": 0.0, "linearity": 0.0, "points": day.count(i, j)}, "walk_split")
        out += ([sat(a, x)] if head else []) + [{**s, "start_ts": x, "end_ts": y, "points": day.count(x, y)}] + ([sat(y, b)] if tail else [])
    return out


def bridge_stays(segments: list[Segment], day: Day) -> list[Segment]:
    """Stays one after the other at one place, ten minutes apart at most, are one if the gap was spent at rest (a calm heart and no step), or, without a gap, unless the
    heart tells of effort over both."""
    out: list[Segment] = []
    first: Segment | None = None  # the stay that the last of `out` began with
    for s in segments:
        a = out[-1] if out else None
        if a and still(a) and still(s) and first is not None and _one_stay(a, s, first, day):
            out[-1] = {**a, "end_ts": s["end_ts"], "points": (a.get("points") or 0) + (s.get("points") or 0)}
            continue
        out.append(s)
        first = s
    return out


def _one_stay(a: Segment, s: Segment, first: Segment, day: Day) -> bool:
    if any(z.get(k) is None for z in (first, s) for k in ("lat", "lon")) or metres(first["lat"], first["lon"], s["lat"], s["lon"]) > JOIN_M:
        return False
    gap = s["start_ts"] - a["end_ts"]
    if gap > JOIN_S:
        return False
    if gap > 0:
        beats = day.beats.inside(a["end_ts"], s["start_ts"])
        return len(beats) >= JOIN_BEATS and beats.mean() <= REST_BPM and day.walked.inside(a["end_ts"], s["start_ts"]).sum() == 0
    both = day.beats.over(a["start_ts"], s["end_ts"])
    return not len(both) or both.mean() <= BOTH_BPM


#: The passes before the cascade, in order.
BEFORE = (split_stays, split_walks, bridge_stays)


def with_evidence(passes: tuple = CASCADE) -> tuple:
    """Cuts and joins on evidence, then the cascade."""
    return (*BEFORE, *passes)
