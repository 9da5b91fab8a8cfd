"""Readers of wearable feeds and map extracts: nested JSON to rows. All take a column of JSON text and never fail on a bad row; what can't be read is null or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrain.functions import geo

FIXES = "user_id long, ts long, lat double, lon double, altitude double, speed double, accuracy double, battery int, device string"


def fixes(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Fixes of [start, end], by time; the range reaches the scan."""
    return spark.read.schema(FIXES).parquet(path).where(F.col("ts").between(start, end)).orderBy("ts")


def deduped_fixes(fixes_: DataFrame) -> DataFrame:
    """One row for each user, time and place to six decimals."""
    key = ["user_id", "ts", F.round("lat", 6), F.round("lon", 6)]
    w = Window.partitionBy(*key).orderBy("lat", "lon")
    return fixes_.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def intraday(df: DataFrame, json: str, path: str, value: str, keys: list[str], date: str, zero_rows: bool = True) -> DataFrame:
    """`$.<path>.dataset` of {time, value}: keys, ts (wall clock), value. zero_rows: whether zeros are kept."""
    kind = f"struct<`{path}`:struct<dataset:array<struct<time:string,value:double>>>>"
    rows = df.select(*keys, date, F.explode(F.from_json(json, kind)[path]["dataset"]).alias("d"))
    out = rows.select(*keys, F.try_to_timestamp(F.concat_ws(" ", F.col(date).cast("string"), F.col("d.time"))).cast("timestamp_ntz").alias("ts"), F.col("d.value").alias(value))
    return out.where("ts is not null") if zero_rows else out.where(F.col(value) > 0).where("ts is not null")


def zones(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """Heart-rate zones of a day: keys, zone_name, min_bpm, max_bpm, minutes."""
    kind = "array<struct<name:string,min:int,max:int,minutes:int>>"
    z = df.select(*keys, F.explode(F.from_json(json, kind)).alias("z"))
    return z.select(*keys, F.col("z.name").alias("zone_name"), F.col("z.min").alias("min_bpm"), F.col("z.max").alias("max_bpm"), F.col("z.minutes").alias("minutes")).where("zone_name is not null")


SLEEP = "struct<logId:bigint,startTime:string,endTime:string,isMainSleep:boolean,minutesAsleep:int,levels:struct<data:array<struct<dateTime:string,level:string,seconds:int>>>>"


def sleeps(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """keys, log_id, start, end, is_main_sleep, minutes_asleep."""
    s = F.from_json(json, SLEEP)
    at = lambda c: F.try_to_timestamp(s[c]).cast("timestamp_ntz")
    return df.select(*keys, s["logId"].alias("log_id"), at("startTime").alias("start"), at("endTime").alias("end"), s["isMainSleep"].alias("is_main_sleep"), s["minutesAsleep"].alias("minutes_asleep")).where("log_id is not null")


def sleep_stages(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """keys, log_id, ts, stage, duration_s."""
    s = df.select(*keys, F.from_json(json, SLEEP).alias("s")).select(*keys, F.col("s.logId").alias("log_id"), F.explode("s.levels.data").alias("d"))
    return s.select(*keys, "log_id", F.try_to_timestamp("d.dateTime").cast("timestamp_ntz").alias("ts"), F.col("d.level").alias("stage"), F.col("d.seconds").alias("duration_s"))


def main_sleep_stages(sleeps_: DataFrame, stages: DataFrame, keys: list[str]) -> DataFrame:
    """The stages of main sleeps."""
    return stages.join(sleeps_.where("is_main_sleep"), [*keys, "log_id"], "left_semi")


def variability(df: DataFrame, json: str, keys: list[str]) -> DataFrame:
    """Five-minute heart-rate variability: keys, minute, rmssd, coverage."""
    kind = "array<struct<minutes:array<struct<minute:string,value:struct<rmssd:double,coverage:double>>>>>"
    m = df.select(*keys, F.explode(F.from_json(json, kind)).alias("d")).select(*keys, F.explode("d.minutes").alias("m"))
    return m.select(*keys, F.try_to_timestamp("m.minute").cast("timestamp_ntz").alias("minute"), F.col("m.value.rmssd").alias("rmssd"), F.col("m.value.coverage").alias("coverage"))


def latest_by_day(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The last row of each key and local date."""
    w = Window.partitionBy(*keys, F.col(ts).cast("date")).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Tags that name a feature's kind, the first that is there telling it.
KINDS = ("aeroway", "railway", "highway", "waterway")


def feature_kind(tags: Column, is_node: Column) -> Column:
    """aeroway, railway, highway, waterway, landmark, building; for nodes that are bus stops or signals, transit_stop."""
    stop = is_node & tags["highway"].isin("bus_stop", "traffic_signals")
    out = F.when(F.coalesce(stop, F.lit(False)), "transit_stop")
    for k in KINDS:
        out = out.when(tags[k].isNotNull(), k)
    return out.when(tags["amenity"].isNotNull() | tags["shop"].isNotNull() | tags["tourism"].isNotNull() | tags["leisure"].isNotNull(), "landmark").when(tags["building"].isNotNull(), "building")


ELEMENT = "struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,ref:bigint,role:string>>>"


def map_features(df: DataFrame, json: str) -> DataFrame:
    """Elements of a map extract, one JSON a row: osm_type, osm_id, feature_type, subtype, name, tags, lat, lon, path. Elements without a kind are left out."""
    e = df.select(F.from_json(json, ELEMENT).alias("e")).select("e.*")
    kind = feature_kind(F.col("tags"), F.col("type") == "node")
    sub = F.when(F.col("feature_type") == "landmark", F.coalesce(*[F.col("tags")[k] for k in ("amenity", "shop", "tourism", "leisure")])).when(F.col("feature_type") == "transit_stop", F.col("tags")["highway"])
    sub = sub.otherwise(F.element_at("tags", F.col("feature_type")))
    out = e.withColumn("feature_type", kind).where("feature_type is not null and tags is not null")
    return out.select(F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), "feature_type", sub.alias("subtype"), F.col("tags")["name"].alias("name"), "tags", "lat", "lon", F.col("geometry").alias("path"))


def routes(df: DataFrame, json: str) -> DataFrame:
    """Relations with a ref or a name and their stops in order (members whose role begins with stop, else with platform): relation_id, ref, name, stops."""
    e = df.select(F.from_json(json, ELEMENT).alias("e")).select("e.*").where("type = 'relation'")
    role = lambda p: F.transform(F.filter("members", lambda m: F.startswith(m["role"], F.lit(p))), lambda m: m["ref"])
    stops = F.when(F.size(role("stop")) > 0, role("stop")).otherwise(role("platform"))
    out = e.select(F.col("id").alias("relation_id"), F.col("tags")["ref"].alias("ref"), F.col("tags")["name"].alias("name"), stops.alias("stops"))
    return out.where("(ref is not null or name is not null) and size(stops) > 0")


def route_stops(routes_: DataFrame, nodes: DataFrame) -> DataFrame:
    """route, seq, name, s_lat, s_lon of routes' stops. nodes: osm_id, name, lat, lon."""
    s = routes_.select(F.coalesce("ref", "name").alias("route"), F.posexplode("stops").alias("seq", "osm_id"))
    return s.join(nodes.select("osm_id", "name", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon")), "osm_id").drop("osm_id")


def polyline(wkt: str) -> Column:
    return geo.parse_linestring(F.col(wkt))


def next_windows(floor_day: int, cursor: int, span: int) -> tuple[int, int] | None:
    """The window of days before a cursor, not before the floor; None when there is none left."""
    return None if cursor <= floor_day else (max(floor_day, cursor - span), cursor - 1)


def plan_backfill(cursors: dict[str, int], empty: dict[str, int], floor_day: int, span: int, most_empty: int = 14) -> list[tuple[str, int, int]]:
    """(stream, first, last) windows of days to fetch next, the stream with the latest cursor first; streams with 14 empty days in a row have ended."""
    out = []
    for name, cursor in sorted(cursors.items(), key=lambda x: (-x[1], x[0])):
        w = next_windows(floor_day, cursor, span)
        if w and empty.get(name, 0) < most_empty:
            out.append((name, *w))
    return out


def forward_start(cursor: int | None, today: int, overlap: int = 2) -> int:
    return today - overlap if cursor is None else min(cursor, today - overlap)
