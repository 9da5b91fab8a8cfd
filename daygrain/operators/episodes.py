"""The line that a map draws for each state of a day.

A state's fixes come by an interval join. Which of them stand (spikes and implausible speeds don't) is a recursion over a state's own fixes, many states a batch; where a
line begins and ends at its neighbours is windows over a day's states.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import geo
from daygrain.operators import groups
from daygrain.operators.joins import in_interval
from daygrain.operators.track import M_PER_DEGREE

#: km/h that nobody goes faster on foot or by bicycle; a spike goes this many times as far and this much farther; metres of a gap that is
#: bridged at most, and of a train's end that is joined to its neighbour at least.
MOST_KMH = {"walking": 12.0, "cycling": 35.0}
SPIKE, SPIKE_M, BRIDGE_M, JOIN_M = 3.0, 500.0, 2000.0, 100.0
MOVING = ("walking", "cycling", "driving", "vehicle", "bus", "boat", "plane")
STILL = ("stationary", "sleeping")
POINT = "struct<lat:double,lon:double,t:bigint>"


def _metres(a: tuple, b: tuple) -> float:
    return float(np.hypot((b[0] - a[0]) * M_PER_DEGREE, (b[1] - a[1]) * M_PER_DEGREE * np.cos(np.radians(a[0]))))


def without_spikes(points: list[tuple]) -> list[tuple]:
    """Points (lat, lon, t) without those to which, and from which, the way is far longer than without them. The first and last stay."""
    if len(points) < 3:
        return list(points)
    kept = [points[0]]
    for p, after in zip(points[1:-1], points[2:], strict=True):
        straight, around = _metres(kept[-1], after), _metres(kept[-1], p) + _metres(p, after)
        if not (around > SPIKE * straight and around - straight > SPIKE_M):
            kept.append(p)
    return [*kept, points[-1]]


def held(points: list[tuple], most_kmh: float | None) -> list[tuple]:
    """The longest run of points in which none is reached faster than that from the one before, the earliest of equal ones: a point that is held back doesn't move the run."""
    if most_kmh is None or len(points) < 2:
        return list(points)
    best: list[tuple] = []
    for i in range(len(points)):
        if len(points) - i <= len(best):
            break
        run = [points[i]]
        for p in points[i + 1 :]:
            s = p[2] - run[-1][2]
            if s > 0 and _metres(run[-1], p) / s * 3.6 <= most_kmh:
                run.append(p)
        if len(run) > len(best):
            best = run
    return best


def _standing(mode: pd.Series, lat: pd.Series, lon: pd.Series, t: pd.Series) -> pd.Series:
    """Which of a moving state's fixes, in order, stand; None where nothing is asked."""

    def one(m: str | None, y: np.ndarray, x: np.ndarray, at: np.ndarray) -> list[int] | None:
        if m is None:
            return None
        points = list(zip(y.tolist(), x.tolist(), at.tolist(), range(len(y)), strict=True))
        return [p[3] for p in held(without_spikes(points), MOST_KMH.get(m))]

    return pd.Series([one(*row) for row in zip(mode, lat, lon, t, strict=True)], dtype=object)


def episodes(states: DataFrame, fixes: DataFrame, keys: list[str], paths: DataFrame | None = None) -> DataFrame:
    """One row a state (keys; start_ts, end_ts, mode): kind, points (array of lat, lon, t), seen (fixes in it), length_m.

    fixes: keys, t, lat, lon. A stay is its fixes' centre (anchor; no point without fixes). A way is the path that was matched to it, clipped to the state (matched), if there
    is one with two points or more, else its own fixes without spikes and, on foot or by bicycle, without implausible speeds (raw). A train's ends join the states beside it
    if they lie apart; an unknown stretch is the connector between its neighbours if that is short (tentative). paths: keys, start_ts, path (as match_legs() gives
    it) of the state that begins there. A fix at the end of one state and the beginning of the next belongs to both."""
    key = [*keys, "start_ts", "end_ts"]
    s = states.select(*key, "mode")
    found = in_interval(fixes.select(*keys, "t", "lat", "lon"), s, keys).unionByName(s, allowMissingColumns=True)  # a state without fixes is a row, too
    fix = F.when(F.col("t").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(F.col("t").cast("long").alias("t"), "lat", "lon"))
    seen = groups.dealt(found, keys).groupBy(*key, "mode").agg(F.sort_array(F.collect_list(fix)).alias("__seen"))
    mode, n, each = F.col("mode"), F.size("__seen"), lambda c: F.col(f"__seen.{c}")
    # Most states have too few fixes for a spike or a pace; only the others go to Python, many a batch.
    asked = ~mode.isin(*STILL, "unknown") & ((n >= 3) | ((n >= 2) & mode.isin(*MOST_KMH)))
    mean = lambda c: F.aggregate(each(c), F.lit(0.0), lambda a, x: a + x) / n
    point = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["t"].alias("t"))
    centre = F.when(n > 0, F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"), F.lit(None).cast("long").alias("t")))
    told = seen.withColumn("__kept", F.pandas_udf(_standing, "array<int>")(F.when(asked, mode), *(F.when(asked, each(c)) for c in ("lat", "lon", "t"))))
    stand = F.when(mode.isin(*STILL, "unknown"), F.array().cast(f"array<{POINT}>")).when(asked, F.transform("__kept", lambda i: point(F.get("__seen", i)))).otherwise(F.transform("__seen", point))
    told = told.select(*key, "mode", n.cast("long").alias("seen"), centre.alias("centre"), F.when(n > 0, point(F.get("__seen", F.lit(0)))).alias("entry"), stand.alias("own"))
    if paths is not None:
        told = told.join(paths.select(*keys, "start_ts", F.col("path").alias("__path")), [*keys, "start_ts"], "left")
        clipped = F.transform(F.filter("__path", lambda p: p["t"].between(F.col("start_ts"), F.col("end_ts"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["t"].cast("long").alias("t")))
        told = told.withColumn("__match", F.when(F.size(clipped) >= 2, clipped)).drop("__path")
    else:
        told = told.withColumn("__match", F.lit(None).cast(f"array<{POINT}>"))
    empty = F.array().cast(f"array<{POINT}>")
    way = mode.isin(*MOVING, "train")
    line = F.when(mode.isin(*STILL), F.when(F.col("centre").isNotNull(), F.array("centre")).otherwise(empty)).when(way, F.coalesce("__match", "own")).otherwise(empty)
    told = told.withColumn("points", line).withColumn("entry", F.when(mode.isin(*STILL), F.coalesce("entry", "centre")).otherwise(F.col("entry")))
    w = Window.partitionBy(*keys).orderBy("start_ts", "end_ts")
    last = lambda c: F.try_element_at(F.col(c), F.lit(-1))
    place = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), F.lit(None).cast("long").alias("t"))
    apart = lambda a, b: geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"])
    # A train's ends first, for what follows it may begin there.
    told = told.withColumn("__to", F.lead("entry").over(w)).withColumn("__from", F.lag(last("points")).over(w))
    open_ = (mode == "train") & F.col("__match").isNull()
    head = F.when(open_ & F.col("__from").isNotNull() & (F.coalesce(apart(F.col("__from"), F.try_element_at("points", F.lit(1))), F.lit(1e9)) > JOIN_M), F.array(place(F.col("__from")))).otherwise(empty)
    tail = F.when(open_ & F.col("__to").isNotNull() & (F.coalesce(apart(F.col("__to"), last("points")), F.lit(1e9)) > JOIN_M), F.array(place(F.col("__to")))).otherwise(empty)
    told = told.withColumn("points", F.concat(head, "points", tail)).withColumn("__from", F.lag(last("points")).over(w))
    near = (mode == "unknown") & F.col("__from").isNotNull() & F.col("__to").isNotNull()
    bridged = F.when(near, apart(F.col("__from"), F.col("__to")) <= BRIDGE_M)
    told = told.withColumn("points", F.when(bridged, F.array(place(F.col("__from")), place(F.col("__to")))).otherwise(F.col("points")))
    kind = F.when(mode.isin(*STILL), "anchor").when(mode == "unknown", "tentative").when(F.col("__match").isNotNull() & way, "matched").otherwise("raw")
    return told.select(*key, "mode", kind.alias("kind"), "points", "seen", geo.path_length(F.col("points")).alias("length_m"))
