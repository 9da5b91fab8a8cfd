"""Order-dependent operators that windows express: islands, runs, fills, gaps, sessions, trailing sums.

All windows are partitioned by a key (a user, a device) and ordered by time and a tie-breaker, so that results repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrain.functions import geo


def islands(df: DataFrame, keys: list[str], order: list[str], same: list[str], gap: Column | None = None, out: str = "island") -> DataFrame:
    """Numbers runs of rows, per key from 1, in which the columns `same` keep their values (null equals null) and `gap` (over lag(...) columns) isn't true."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.row_number().over(w) == 1
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if gap is not None:
        change = change | F.coalesce(gap, F.lit(False))
    marked = df.withColumn(out, F.coalesce(change, F.lit(True)).cast("int"))
    return marked.withColumn(out, F.sum(out).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def since_previous(t: str, keys: list[str], order: list[str]) -> Column:
    return F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))


def sessions(df: DataFrame, keys: list[str], t: str, tie: str, idle_s: int) -> DataFrame:
    """One row a session: a run of rows with at most `idle_s` seconds between neighbours. start_ts, end_ts, n."""
    marked = islands(df, keys, [t, tie], [], since_previous(t, keys, [t, tie]) > idle_s, "session")
    return marked.groupBy(*keys, "session").agg(F.min(t).alias("start_ts"), F.max(t).alias("end_ts"), F.count("*").alias("n"))


def run_ends(df: DataFrame, keys: list[str], t: str, tie: str, value: str) -> DataFrame:
    """A series cut to the first and last row of each run of equal values; of rows with one time the first stays."""
    w = Window.partitionBy(*keys, t).orderBy(tie)
    one = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    w = Window.partitionBy(*keys).orderBy(t)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    edge = ~F.col(value).eqNullSafe(before) | ~F.col(value).eqNullSafe(after)
    first, last = F.row_number().over(w) == 1, F.lead(t).over(w).isNull()
    return one.withColumn("__on", edge | first | last).where("__on").drop("__on")


def drop_unchanged(df: DataFrame, keys: list[str], t: str, tie: str, value: str) -> DataFrame:
    """Of rows with one time the last stays; then rows whose value is that of the row before go."""
    w = Window.partitionBy(*keys, t).orderBy(F.col(tie).desc())
    one = df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    w = Window.partitionBy(*keys).orderBy(t)
    return one.withColumn("__on", (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))).where("__on").drop("__on")


def spine(bounds: DataFrame, start: str, end: str, step_s: int, out: str = "t") -> DataFrame:
    """A row for each step of [start, end) of each row."""
    return bounds.where(F.col(start) < F.col(end)).withColumn(out, F.explode(F.sequence(F.col(start), F.col(end) - 1, F.lit(step_s).cast("long"))))


def filled(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """prev_<value> and next_<value>: the nearest non-null values at or before, and at or after, each row."""
    upto = lambda *o: F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0))
    # Ahead by the order turned round, for a frame up to the end is computed anew for each row.
    return df.withColumn(f"prev_{value}", upto(*order)).withColumn(f"next_{value}", upto(*map(F.desc, order)))


def reacquire_age(df: DataFrame, keys: list[str], t: str, has: str, least_gap_s: int = 300) -> DataFrame:
    """reacquire_s: seconds since a signal came back after a gap of `least_gap_s` or more; null without such a gap or signal. Rows are a grid."""
    w = Window.partitionBy(*keys).orderBy(t)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last_seen = F.last(F.when(F.col(has), F.col(t)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__back", F.when(F.col(has) & (F.col(t) - last_seen >= least_gap_s), F.col(t)))
    return marked.withColumn("reacquire_s", F.when(F.col(has), F.col(t) - F.last("__back", ignorenulls=True).over(upto))).drop("__back")


def hops(df: DataFrame, keys: list[str], order: list[str], t: str = "t", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """gap_s, hop_m, hop_kmh from the row before; null for the first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col(t) - F.lag(t).over(w)
    hop = geo.haversine(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    out = df.withColumn("gap_s", gap).withColumn("hop_m", hop)
    return out.withColumn("hop_kmh", F.when(F.col("gap_s") > 0, F.col("hop_m") / F.col("gap_s") * 3.6))


def trailing(df: DataFrame, keys: list[str], order: list[str], span_s: int = 600, t: str = "t", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """path_m, net_m, effective_kmh, straightness over the rows of the last `span_s` seconds, both ends included.

    A hop counts where both its ends are in the span."""
    h = hops(df, keys, order, t, lat, lon)
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-span_s, 0)
    first = F.min(F.struct(F.col(t).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order[1:])], F.col(lat).alias("lat"), F.col(lon).alias("lon"))).over(w)
    out = h.withColumn("__first", first)
    out = out.withColumn("__hop_in", F.when(F.col("gap_s").isNotNull(), F.struct((F.col(t) - F.col("gap_s")).alias("from"), F.col("hop_m").alias("m"))))
    seen = F.collect_list("__hop_in").over(w)
    out = out.withColumn("path_m", F.aggregate(F.filter(seen, lambda x: x["from"] >= F.col(t) - span_s), F.lit(0.0), lambda s, x: s + x["m"]))
    out = out.withColumn("net_m", geo.haversine(F.col("__first.lat"), F.col("__first.lon"), F.col(lat), F.col(lon)))
    out = out.withColumn("effective_kmh", F.when(F.col(t) > F.col("__first.t"), F.col("net_m") / (F.col(t) - F.col("__first.t")) * 3.6))
    out = out.withColumn("straightness", F.when(F.col("path_m") > 0, F.least(F.lit(1.0), F.col("net_m") / F.col("path_m"))))
    return out.drop("__first", "__hop_in")


def drop_outliers(df: DataFrame, keys: list[str], t: str = "t", lat: str = "lat", lon: str = "lon", span_s: int = 1800, far_m: float = 2000.0, least: int = 5) -> DataFrame:
    """Without the fixes that lie more than `far_m` from the median of those within `span_s` of them, where there are `least` or more."""
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(-span_s, span_s)
    marked = df.withColumn("__n", F.count("*").over(w))
    mid = lambda c: F.expr(f"array_sort({c})")
    for c in (lat, lon):
        marked = marked.withColumn(f"__{c}", F.collect_list(c).over(w)).withColumn(f"__{c}", mid(f"__{c}"))
        at = F.col(f"__{c}")
        half = (F.size(at) / 2).cast("int")
        marked = marked.withColumn(f"__{c}", F.when(F.size(at) % 2 == 1, at[half]).otherwise((at[half - 1] + at[half]) / 2))
    far = geo.haversine(F.col(f"__{lat}"), F.col(f"__{lon}"), F.col(lat), F.col(lon)) > far_m
    return marked.where((F.col("__n") < least) | ~far).drop("__n", f"__{lat}", f"__{lon}")


def time_labels(df: DataFrame, keys: list[str], count: int, tz: str = "UTC", t: str = "t") -> DataFrame:
    """Per key first_ts, last_ts, total_s (1 at least) over all of its series, and `count` + 1 even labels HH:MM between."""
    r = df.groupBy(*keys).agg(F.min(t).alias("first_ts"), F.max(t).alias("last_ts"))
    r = r.withColumn("total_s", F.greatest(F.col("last_ts") - F.col("first_ts"), F.lit(1)))
    at = F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: F.floor(F.col("first_ts") + F.col("total_s") * i / count))
    return r.withColumn("labels", F.transform(at, lambda x: F.date_format(F.from_utc_timestamp(F.timestamp_seconds(x), tz), "HH:mm")))
