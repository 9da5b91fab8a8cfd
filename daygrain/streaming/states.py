"""Motion state of devices as a stateful processor: lists and values of state, event-time timers, and a store to begin with.

The recursion is that of motion.py, message by message. What a function over groups can't do, this does: the end of a profile that was chosen by hand is told when event
time passes it, whether a message comes or not; a device that is silent for long is forgotten by event time, so that a replay of old data forgets as the stream did; and
the fixes of a store are its state from the start, joined to no message. It needs a session with the RocksDB state store (see CONF) and a watermark on the messages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from daygrain.cluster import ship
from daygrain.streaming.motion import CONFIG, OUT, SPAN_S, START, _run

CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
FIXES, MODE = "t bigint, lat double, lon double", "profile string, hold bigint, rests boolean"


class Motion(StatefulProcessor):
    """State of a device: its fixes of ten minutes, and its profile, until when that holds, and whether it rests when it no longer does."""

    def __init__(self, idle_s: int):
        self.idle_s = idle_s

    def init(self, handle) -> None:
        self.handle = handle
        self.fixes, self.mode = handle.getListState("fixes", FIXES), handle.getValueState("mode", MODE)

    def _load(self) -> tuple:
        fixes = sorted(tuple(f) for f in self.fixes.get()) if self.fixes.exists() else []
        profile, hold, _ = self.mode.get() if self.mode.exists() else (*START[3:], False)
        return *([f[i] for f in fixes] for i in range(3)), profile, hold

    def _save(self, state: tuple, rests: bool) -> None:
        ts, lat, lon, profile, hold = state
        if ts:
            self.fixes.put([(int(t), float(y), float(x)) for t, y, x in zip(ts, lat, lon, strict=True)])
        self.mode.update((profile, int(hold), bool(rests)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rests:
            self.handle.registerTimer(1000 * int(hold))
        if ts:
            self.handle.registerTimer(1000 * (int(ts[-1]) + self.idle_s))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            told = sorted(zip(row.seed_t, row.seed_lat, row.seed_lon, strict=True))
            if told:
                self._save((*map(list, zip(*told, strict=True)), *START[3:]), False)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows))
        state, out = _run(key[0], some, self._load())
        last = some.sort_values(["t", "seq"]).iloc[-1]
        ts, _, _, profile, hold = state
        waits = bool(last.long_stay) and CONFIG[profile][0] != "significant" and ts[-1] - ts[0] >= SPAN_S - 60 and out.speed_kmh.iloc[-1] < 2 and last.t < hold
        self._save(state, waits)
        yield out.assign(by_timer=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if not self.mode.exists():
            return
        state = self._load()
        if state[0] and now >= state[0][-1] + self.idle_s:
            self.fixes.clear()
            self.mode.clear()
            return
        if self.mode.get()[2] and now >= state[4]:
            reporting, every = CONFIG["stationary"]
            self._save((*state[:3], "stationary", state[4]), False)
            yield pd.DataFrame([(key[0], now, "stationary", reporting, every, 0.0, True)], columns=[*COLUMNS, "by_timer"])


def initial(history: DataFrame) -> DataFrame:
    """A store's fixes (device, t, lat, lon) as state to begin with: those of the last ten minutes each device was seen."""
    last = history.groupBy("device").agg(F.max("t").alias("__last"))
    recent = history.join(last, "device").where(F.col("t") >= F.col("__last") - SPAN_S)
    f = recent.groupBy("device").agg(F.sort_array(F.collect_list(F.struct("t", "lat", "lon"))).alias("f"))  # ten minutes of one device
    return f.select("device", F.col("f.t").alias("seed_t"), F.col("f.lat").alias("seed_lat"), F.col("f.lon").alias("seed_lon"))


def motion_states(messages: DataFrame, history: DataFrame | None = None, idle: str = "1 day", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The profile after each message (device, t, seq, lat, lon, vel, trigger, long_stay, and `ts`, the time of t) of a stream, and by_timer: rows of a device that
    came to rest when its hold ended. Messages later than the watermark are dropped; a device is forgotten when event time is `idle` past its last fix."""
    ship(messages.sparkSession)
    grouped = messages.withWatermark(ts, late).groupBy("device")
    seeds = None if history is None else initial(history).groupBy("device")
    return grouped.transformWithStateInPandas(Motion(int(pd.Timedelta(idle).total_seconds())), OUT + ", by_timer boolean", "Append", "EventTime", initialState=seeds)
