"""Motion state of devices, message by message, and event-time aggregates of streams.

The state of a device holds its trailing ten minutes of fixes, its last profile and until when a profile chosen by hand holds. The same
function runs over a batch, so that a stream can be checked against it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from daygrain.cluster import ship
from daygrain.operators import groups
from daygrain.operators.track import haversine

SPAN_S, HOLD_S = 600, 600
#: What each profile asks of a device, as (mode of reporting, seconds between fixes).
CONFIG = {"stationary": ("significant", 900), "walking": ("move", 30), "transit": ("move", 10), "transit-fast": ("move", 5)}
OUT = "device string, t long, profile string, reporting string, interval_s int, speed_kmh double"
STATE = "ts array<bigint>, lat array<double>, lon array<double>, profile string, hold_until bigint"


def trailing_speed(t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> float:
    """Net displacement over the span, in km/h; 0 for one fix."""
    return float(haversine(lat[0], lon[0], lat[-1], lon[-1]) / (t[-1] - t[0]) * 3.6) if len(t) > 1 and t[-1] > t[0] else 0.0


def by_speed(kmh: float) -> str:
    return "transit-fast" if kmh > 80 else "transit" if kmh > 30 else "walking" if kmh > 2 else "stationary"


def decide(profile: str, reporting: str, trigger: str | None, kmh: float, gap_s: float | None, span_s: float, long_stay: bool, held: bool) -> str:
    """The next profile of a device. Fast ones rise at once; a device at rest wakes by hand, by close fixes or by movement; a moving one rests when it stood at a
    place of long stays for nine minutes and nobody holds it awake."""
    if kmh > 30:
        return by_speed(kmh)
    if reporting == "significant":
        if trigger == "u" or (gap_s is not None and gap_s < 300) or kmh > 2:
            return by_speed(kmh) if span_s >= 120 and kmh > 2 else "walking"
        return profile
    if long_stay and span_s >= 540 and kmh < 2 and not held:
        return "stationary"
    return by_speed(kmh) if kmh > 2 else profile


def advance(state: tuple, message) -> tuple[tuple, dict]:
    """(state, message) to (state, output). A message: t, lat, lon, vel, trigger, long_stay. One that is older than the last changes nothing but is answered."""
    ts, lats, lons, profile, hold = state
    t = int(message.t)
    gap = t - ts[-1] if ts else None
    if gap is None or gap >= 0:
        keep = [i for i, x in enumerate(ts) if x >= t - SPAN_S]
        ts, lats, lons = ([*[v[i] for i in keep], x] for v, x in ((ts, t), (lats, float(message.lat)), (lons, float(message.lon))))
    if message.trigger == "u":
        hold = t + HOLD_S
    computed = trailing_speed(np.asarray(ts), np.asarray(lats), np.asarray(lons))
    reported = 0.0 if message.vel is None or pd.isna(message.vel) else float(message.vel)
    kmh = max(computed, reported)
    profile = decide(profile, CONFIG[profile][0], message.trigger, kmh, gap, ts[-1] - ts[0], bool(message.long_stay), t < hold)
    reporting, every = CONFIG[profile]
    return (ts, lats, lons, profile, hold), {"t": t, "profile": profile, "reporting": reporting, "interval_s": every, "speed_kmh": round(kmh, 1)}


START = ([], [], [], "stationary", 0)


def _run(device: str, rows: pd.DataFrame, state: tuple) -> tuple[tuple, pd.DataFrame]:
    out = []
    for m in rows.sort_values(["t", "seq"]).itertuples():
        state, told = advance(state, m)
        out.append({"device": device, **told})
    return state, pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def motion_batch(messages: DataFrame) -> DataFrame:
    """The profile after each message of each device (device, t, seq, lat, lon, vel, trigger, long_stay), over a whole table."""
    return groups.dealt(messages, ["device"]).groupBy("device").applyInPandas(lambda g: _run(g.device.iloc[0], g, START)[1], OUT)


def seeded(messages: DataFrame, history: DataFrame) -> DataFrame:
    """Messages with what a device did before the stream began: seed_t, seed_lat, seed_lon, its stored fixes of the last ten minutes it was seen.

    history: device, t, lat, lon, a table. A device without any has nulls."""
    last = history.groupBy("device").agg(F.max("t").alias("__last"))
    recent = history.join(last, "device").where(F.col("t") >= F.col("__last") - SPAN_S)
    fixes = F.sort_array(F.collect_list(F.struct("t", "lat", "lon"))).alias("f")  # ten minutes of one device
    s = recent.groupBy("device").agg(fixes).select("device", F.col("f.t").alias("seed_t"), F.col("f.lat").alias("seed_lat"), F.col("f.lon").alias("seed_lon"))
    return messages.join(s, "device", "left")


def motion_stream(messages: DataFrame, idle: str | None = "1 day") -> DataFrame:
    """The same over a stream, in order of arrival between micro-batches and of time within one. A device's state is ten minutes of fixes and three
    values; it goes when no message came for `idle` (None: it stays, and a bounded run can end), and begins with the fixes of seeded(), where
    the messages have them."""
    ship(messages.sparkSession)
    wait_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    begins = "seed_t" in messages.columns

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))
        old = START
        if state.exists:
            ts, lat, lon, profile, hold = state.get
            old = list(ts), list(lat), list(lon), profile, hold
        elif begins and rows.seed_t.iloc[0] is not None:
            old = *([*rows[c].iloc[0]] for c in ("seed_t", "seed_lat", "seed_lon")), *START[3:]
        new, out = _run(key[0], rows, old)
        state.update((new[0], new[1], new[2], new[3], new[4]))
        if wait_ms:
            state.setTimeoutDuration(wait_ms)
        yield out

    return messages.groupBy("device").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if wait_ms else GroupStateTimeout.NoTimeout)


def with_long_stay(messages: DataFrame, places: DataFrame) -> DataFrame:
    """Messages with long_stay: within 100 m of a place where people stay long. places: p_lat, p_lon of those. For a stream the places are static.

    The join is by cells, with a row a message: its nearest cells' places are gathered in one lookup row per cell."""
    from daygrain.functions import geo

    size, near_m = 0.002, 100.0
    p = places.select("p_lat", "p_lon", F.explode(geo.cells_near(F.col("p_lat"), F.col("p_lon"), size, near_m)).alias("__c")).select("p_lat", "p_lon", "__c.*")
    p = p.groupBy("__cy", "__cx").agg(F.collect_list(F.struct("p_lat", "p_lon")).alias("__near"))
    cy = geo.cell(F.col("lat"), size)
    m = messages.withColumn("__cy", cy).withColumn("__cx", geo.band_cell(F.col("lon"), geo.band_cells(cy, size, near_m))).join(p, ["__cy", "__cx"], "left")
    on = F.exists("__near", lambda x: geo.haversine(x["p_lat"], x["p_lon"], F.col("lat"), F.col("lon")) <= near_m)
    return m.withColumn("long_stay", F.coalesce(on, F.lit(False))).drop("__cy", "__cx", "__near")


def event_time(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """A stream with a watermark on a time that may lack a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, keys: list[str], value: str, size: str = "5 minutes", ts: str = "ts") -> DataFrame:
    w = F.window(ts, size)
    out = events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def session_windows(events: DataFrame, keys: list[str], idle: str = "30 minutes", ts: str = "ts") -> DataFrame:
    w = F.session_window(ts, idle)
    out = events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def insert_ignore(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)
