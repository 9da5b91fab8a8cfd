"""Distances and bearings as Column expressions. Latitudes and longitudes are in degrees, distances in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
M_PER_DEGREE = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def flat(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Equirectangular distance, good over some kilometres."""
    dx = (lon2 - lon1) * M_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * M_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def to_segment_deg(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance, in degrees, of a point from a line segment; both axes have one scale."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def to_segment(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of a point from a line segment on the plane that touches at the point."""
    k = F.cos(F.radians(lat)) * M_PER_DEGREE
    first = around(lon1 - lon)
    return to_segment_deg(F.lit(0.0), F.lit(0.0), (lon1 - lon + first) * k, (lat1 - lat) * M_PER_DEGREE, (lon2 - lon + first + around(lon2 - lon1)) * k, (lat2 - lat) * M_PER_DEGREE)


def share_along(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Where on a line segment the nearest point to a point lies, 0 to 1, on the plane that touches at the point."""
    k = F.cos(F.radians(lat)) * M_PER_DEGREE
    ax, ay = (lon1 - lon + around(lon1 - lon)) * k, (lat1 - lat) * M_PER_DEGREE
    dx, dy = (lon2 - lon1 + around(lon2 - lon1)) * k, (lat2 - lat1) * M_PER_DEGREE
    n = dx * dx + dy * dy
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / n))).otherwise(0.0)


def around(d: Column) -> Column:
    """What a difference of longitudes lacks to the shorter way around: 0, or 360 with its sign turned."""
    return F.when(F.abs(d) <= 180, 0.0).otherwise(-360.0 * F.signum(d))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    y = F.sin(d) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def unit(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A place on the unit sphere."""
    y, x = F.radians(lat), F.radians(lon)
    return F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)


def chord_square(radius_m: float) -> float:
    """The square of the distance of two places of unit() that are that far apart on the earth, with room for rounding."""
    return (2 * math.sin(min(radius_m / EARTH_RADIUS_M, math.pi) / 2)) ** 2 * (1 + 1e-6) + 1e-13


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def band_size(radius_m: float) -> float:
    """Degrees of latitude that a great circle of that length spans at most."""
    return math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)


def band_cells(band: Column, size: float, radius_m: float) -> Column:
    """Cells around the earth in a band (cell of latitude), so wide that a point of the band and one of its neighbours', at most `radius_m` apart, lie in
    the same cell or in adjacent ones. The first and the last are adjacent; about a pole there is one."""
    top = F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(size)
    chord = math.sin(min(radius_m / EARTH_RADIUS_M, math.pi) / 2)
    wide = F.degrees(2 * F.asin(F.least(F.lit(1.0), chord / F.cos(F.radians(F.least(top, F.lit(90.0)))))))
    return F.when(top >= 90, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360 / (wide * (1 + 1e-9))))).cast("long")


def band_cell(lon: Column, cells: Column) -> Column:
    """The cell of a longitude among a band's."""
    return F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360.0 * cells), cells - 1).cast("long")


def cells_near(lat: Column, lon: Column, size: float, radius_m: float) -> Column:
    """array<struct<__cy, __cx>>: the cells in which points at most `radius_m` away lie, each once; `size` is band_size() or more."""

    def of(d: int) -> Column:
        cy = cell(lat, size) + d
        n = band_cells(cy, size, radius_m)
        return F.transform(F.array_distinct(F.array(*[F.pmod(band_cell(lon, n) + k, n) for k in (-1, 0, 1)])), lambda x: F.struct(cy.alias("__cy"), x.alias("__cx")))

    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*[of(d) for d in (-1, 0, 1)]))


def box_around(lat: Column, lon: Column, radius_m: Column | float) -> Column:
    """struct<south, north, west, east> that holds the disc."""
    r = F.lit(radius_m) if isinstance(radius_m, int | float) else radius_m
    dy = r / M_PER_DEGREE
    dx = r / (M_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return F.struct((lat - dy).alias("south"), (lat + dy).alias("north"), (lon - dx).alias("west"), (lon + dx).alias("east"))


def in_box(lat: Column, lon: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def box_covers(outer: tuple[Column, Column, Column, Column], inner: Column) -> Column:
    """Whether one box (south, north, west, east) holds a struct made by box_around()."""
    s, n, w, e = outer
    return (inner["south"] >= s) & (inner["north"] <= n) & (inner["west"] >= w) & (inner["east"] <= e)


def path_length(points: Column) -> Column:
    """Length of an array<struct<lat, lon>>; 0 for fewer than two points."""
    n = F.size(points)
    pairs = F.when(n > 1, F.zip_with(F.slice(points, 1, n - 1), F.slice(points, 2, n - 1), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))).otherwise(F.array().cast("array<double>"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def parse_linestring(wkt: Column) -> Column:
    """array<struct<lat, lon>> of LINESTRING(x y, ...), x being the longitude; null for anything else."""
    inside = F.regexp_extract(wkt, r"^\s*LINESTRING\s*\(([^()]*)\)\s*$", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    points = F.transform(F.split(inside, ","), lambda p: F.struct(F.element_at(pair(p), 2).cast("double").alias("lat"), F.element_at(pair(p), 1).cast("double").alias("lon")))
    return F.when(F.length(inside) > 0, points)


def parse_point(wkt: Column) -> Column:
    """struct<lat, lon> of POINT(x y); null for anything else."""
    m = lambda k: F.regexp_extract(wkt, r"^\s*POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)\s*$", k)
    return F.when(F.length(m(1)) > 0, F.struct(m(2).cast("double").alias("lat"), m(1).cast("double").alias("lon")))
