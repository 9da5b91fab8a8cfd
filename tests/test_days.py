"""Queries over days that SQL can't state, against plain versions over whole tables."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from daygrain.operators import hsmm, track
from daygrain.plans import days
from daygrain.plans.derived import fixes, spans, spots


def by_key(df, *keys):
    out = defaultdict(list)
    for r in df.collect():
        out[tuple(r[k] for k in keys)].append(r)
    return out


def emissions(spark, sf):
    o = days._hours(spark, sf).select("user_id", "day_start", "t", *[hsmm.mode_emission(m, F.col("speed_kmh"), F.col("hr"), F.col("cadence")).alias(m) for m in hsmm.MODES])
    return {k: sorted(v, key=lambda r: r["t"]) for k, v in by_key(o, "user_id", "day_start").items()}


def score(path, nats, way, long):
    """Nats of a segmentation: (state, first, behind the last)."""
    total, before = -np.log(len(way)), None
    for s, a, b in path:
        total += sum(nats[t][s] for t in range(a, b)) + long[s, b - a - 1] + (0 if before is None or before == s else way[before, s])
        before = s
    return total


def test_decode_is_the_best_of_each_day(spark, sf):
    """A plain recursion over (hour, state) with memory, of each day by itself, reaches the same nats as the segments that come out."""
    space = hsmm.states([], [])
    way, long = hsmm.transitions(space), hsmm.durations(space, step_s=3600)
    got = by_key(days.day_decode(spark, sf), "user_id", "day_start")
    seen = emissions(spark, sf)
    assert set(got) == set(seen) and len(seen) > 300
    most = long.shape[1]
    for key, rows in list(seen.items()):
        nats = [[r[s.mode] - (2.0 if s.mode == "stationary" else 0.0) for s in space] for r in rows]
        n = len(nats)
        best = [[-np.inf] * len(space) for _ in range(n + 1)]  # a segment ends before t, in s; and whether it is as long as the table
        full = [[False] * len(space) for _ in range(n + 1)]
        enter = [[-np.inf] * len(space) for _ in range(n + 1)]
        enter[0] = [-np.log(len(space))] * len(space)
        for t in range(1, n + 1):
            for s in range(len(space)):
                run = 0.0
                for d in range(1, min(most, t) + 1):
                    run += nats[t - d][s]
                    x = enter[t - d][s] + run + long[s, d - 1]
                    if x > best[t][s] + 1e-12:
                        best[t][s], full[t][s] = x, d == most
            for s in range(len(space)):
                enter[t][s] = max([best[t][p] + way[p, s] for p in range(len(space)) if p != s] + ([best[t][s]] if full[t][s] else []))
        segments = sorted(got[key], key=lambda r: r["start_ts"])
        assert segments[0]["start_ts"] == rows[0]["t"] and segments[-1]["end_ts"] == rows[-1]["t"] + 3600 and all(a["end_ts"] == b["start_ts"] for a, b in zip(segments, segments[1:], strict=False))
        # A segment that comes out is one or more of the table's length and a rest; the best way to cut it is found by the same table.
        assert abs(max(best[n]) - _nats(segments, rows, nats, space, way, long)) < 1e-6


def _nats(segments, rows, nats, space, way, long):
    total, before, at = -np.log(len(space)), None, 0
    place = {s.mode: i for i, s in enumerate(space)}
    most = long.shape[1]
    for g in segments:
        s, n = place[g["mode"]], (g["end_ts"] - g["start_ts"]) // 3600
        total += sum(nats[at + i][s] for i in range(n)) + (0 if before is None else way[before, s])
        best = [0.0] + [-np.inf] * n  # chains of whole lengths, then a rest
        for i in range(1, n + 1):
            for d in range(1, min(most, i) + 1):
                if i == n or d == most:
                    best[i] = max(best[i], best[i - d] + long[s, d - 1])
        total, before, at = total + best[n], s, at + n
    return total


def test_marginals_sum_over_all_segmentations(spark, sf):
    """Of some days' first hours, all segmentations by hand."""
    space = [hsmm.State(m) for m in hsmm.MODES[:3]]
    way, long = hsmm.transitions(space), hsmm.durations(space, step_s=3600)
    for rows in list(emissions(spark, sf).values())[:5]:
        nats = np.asarray([[r[s.mode] for s in space] for r in rows[:5]])
        mass = np.zeros(nats.shape)

        def walk(t, before, told):
            if t == len(nats):
                w = np.exp(score(told, nats, way, long))
                for s, a, b in told:
                    mass[a:b, s] += w
                return
            for s in range(len(space)):
                if s != before:
                    for d in range(1, min(long.shape[1], len(nats) - t) + 1):
                        walk(t + d, s, [*told, (s, t, t + d)])

        walk(0, None, [])
        want = mass / mass.sum(1, keepdims=True)
        assert np.allclose(hsmm.marginals(nats, way, long, np.full(len(space), -np.log(len(space)))), want)


def test_stays_are_as_by_hand(spark, sf):
    got = {k: sorted((r["start_ts"], r["end_ts"], r["n"]) for r in v) for k, v in by_key(days.stay_mining(spark, sf), "user_id").items()}
    want = {}
    for k, rows in by_key(fixes(spark, sf).where("accuracy <= 200"), "user_id").items():
        rows.sort(key=lambda r: (r["t"], r["event_id"]))
        out, i = [], 0
        while i < len(rows):
            j = i + 1
            while j < len(rows):
                some = rows[i : j + 1]
                y, x = (sorted(r[c] for r in some)[len(some) // 2] for c in ("lat", "lon"))
                if max(track.haversine(y, x, r["lat"], r["lon"]) for r in some) > track.STAY_M:
                    break
                j += 1
            if j - i >= 2 and rows[j - 1]["t"] - rows[i]["t"] >= track.STAY_S:
                out.append((rows[i]["t"], rows[j - 1]["t"], j - i))
                i = j
            else:
                i += 1
        if out:
            want[k] = sorted(out)
    assert got == want


def test_clusters_are_as_by_merging_the_nearest(spark, sf):
    """No stay is farther from another cluster's centre than first fit and merging allow: centres lie apart, and each is its stays' mean."""
    s = spans(spark, sf).join(spots(spark), F.col("spot") == F.col("place_id")).select("user_id", "start_ts", "end_ts", (F.col("p_lat") + F.col("event_id") % 7 * 0.0002).alias("lat"), F.col("p_lon").alias("lon"))
    for rows in by_key(track.clusters(s, ["user_id"], split=False), "user_id").values():
        centre = {}
        for c in {r["cluster"] for r in rows}:
            mine = [r for r in rows if r["cluster"] == c]
            w = [max(float(r["end_ts"] - r["start_ts"]), 1.0) for r in mine]
            centre[c] = (np.average([r["lat"] for r in mine], weights=w), np.average([r["lon"] for r in mine], weights=w))
        assert sorted(centre) == list(range(len(centre)))
        assert all(track.haversine(*centre[a], *centre[b]) > track.CLUSTER_M - 1e-6 for a in centre for b in centre if a < b)


def test_greedy_identity_is_as_by_hand(spark, sf):
    got = sorted(map(tuple, days.greedy_identity(spark, sf).select("user_id", "old_id", "new_id").collect()))
    s = spans(spark, sf).join(spots(spark), F.col("spot") == F.col("place_id")).collect()
    place = {r["spot"]: (r["p_lat"], r["p_lon"]) for r in s}
    want = []
    for u in {r["user_id"] for r in s}:
        old, new = ({r["spot"] for r in s if r["user_id"] == u and (r["start_ts"] < 1_705_276_800) == first} for first in (True, False))
        pairs = sorted((round(float(track.haversine(*place[a], *place[b])), 6), a, b) for a in old for b in new)
        used = (set(), set())
        for d, a, b in pairs:
            if d <= 1800 and a not in used[0] and b not in used[1]:
                used[0].add(a)
                used[1].add(b)
                want.append((u, a, b))
    assert got == sorted(want)


def test_kept_fixes_are_as_by_hand(spark, sf):
    """The quality filter over the whole table, written plainly: from the last kept fix on, one that jumps is passed over if a sound one follows soon."""
    from daygrain.operators.track import BRIDGE_FAR_M, BRIDGE_S, COARSE_KMH, COARSE_M, TELEPORT_KMH, WORST_ACCURACY_M

    got = {k: {r["event_id"] for r in v} for k, v in by_key(days.quality_filter(spark, sf), "user_id").items()}
    want = {}
    for key, rows in by_key(fixes(spark, sf), "user_id").items():
        rows = [r for r in sorted(rows, key=lambda r: (r["t"], r["event_id"])) if not r["accuracy"] > WORST_ACCURACY_M]

        def metres(a, b):
            y, x = (b["lat"] - a["lat"]) * 111_320, (b["lon"] - a["lon"]) * 111_320 * np.cos(np.radians((a["lat"] + b["lat"]) / 2))
            return float(np.hypot(x, y))

        def pace(a, b, metres=metres):
            d = metres(a, b)
            return d / (b["t"] - a["t"]) * 3.6 if b["t"] > a["t"] else float("inf") if d > 0 else 0.0

        def bad(a, b, pace=pace):
            return pace(a, b) > TELEPORT_KMH or (b["accuracy"] > COARSE_M and pace(a, b) > COARSE_KMH)

        kept, i = rows[:1], 1
        while i < len(rows) and len(rows) > 2:
            a, r, take = kept[-1], rows[i], i
            if bad(a, r):
                for j in range(i + 1, len(rows)):
                    if rows[j]["t"] - r["t"] > BRIDGE_S:
                        break
                    if not bad(a, rows[j]) and not rows[j]["accuracy"] > COARSE_M and (j + 1 == len(rows) or pace(rows[j], rows[j + 1]) <= TELEPORT_KMH):
                        take = j if pace(a, r) > TELEPORT_KMH or metres(a, rows[j]) > BRIDGE_FAR_M else i
                        break
            kept.append(rows[take])
            i = take + 1
        want[key] = {r["event_id"] for r in (kept if len(rows) > 2 else rows)}
    assert got == want and sum(map(len, got.values())) > 500


def test_two_times_of_day_are_as_by_hand(spark, sf):
    """circle_kmeans over the whole table: each event lies nearer to its own group's mean direction than to the other's, and the earlier group is 0."""
    got = {r["event_id"]: r["side"] for r in days.circle_kmeans(spark, sf).collect()}
    for rows in by_key(fixes(spark, sf), "event_type", "spot").values():
        angle = np.array([r["t"] % 86_400 / 86_400 * 2 * np.pi for r in rows])
        side = np.array([got[r["event_id"]] for r in rows])
        p = np.stack([np.cos(angle), np.sin(angle)], 1)
        if len(set(side)) < 2:
            continue
        c = np.stack([p[side == k].mean(0) for k in (0, 1)])
        d = ((p[:, None] - c[None]) ** 2).sum(2)
        assert (d[np.arange(len(side)), side] <= d[np.arange(len(side)), 1 - side] + 1e-9).all()
        at = np.arctan2(c[:, 1], c[:, 0]) % (2 * np.pi)
        assert at[0] <= at[1]
    assert len(got) == fixes(spark, sf).count()
