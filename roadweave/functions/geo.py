"""Geometry on the sphere and in map tiles, as column expressions. Points are structs with lon and lat in degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius of the Earth, a mile and a foot, in metres.
EARTH, MILE, FOOT = 6_371_008.8, 1_609.344, 0.3048


def point(lon, lat) -> Column:
    return F.struct(F.col(lon).alias("lon") if isinstance(lon, str) else lon.alias("lon"), F.col(lat).alias("lat") if isinstance(lat, str) else lat.alias("lat"))


def haversine(a: Column, b: Column) -> Column:
    """Great-circle metres."""
    p, q = F.radians(a["lat"]), F.radians(b["lat"])
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(b["lon"]) - F.radians(a["lon"])) / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(a: Column, b: Column) -> Column:
    """Degrees from north, 0 to 360, at a."""
    p, q, d = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lon"] - a["lon"])
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def bearing_delta(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings, 0 to 180."""
    return F.abs(F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0)


def project_onto_segment(p: Column, a: Column, b: Column) -> Column:
    """struct(distance in metres, t in 0..1): the nearest point of segment a-b, in a local plane."""
    scale = F.cos(F.radians((a["lat"] + b["lat"]) / 2))
    dx, dy = (b["lon"] - a["lon"]) * scale, b["lat"] - a["lat"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["lon"] - a["lon"]) * scale * dx + (p["lat"] - a["lat"]) * dy) / F.nullif(square, F.lit(0.0)))))
    near = F.struct((a["lon"] + (b["lon"] - a["lon"]) * t).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * t).alias("lat"))
    return F.struct(haversine(p, near).alias("distance"), t.alias("t"))


def distance_to_line(p: Column, line: Column) -> Column:
    """Metres from p to the nearest point of a line of two points or more."""
    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: project_onto_segment(p, F.get(line, i - 1), F.get(line, i))["distance"]))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether (x, y) lies in a closed ring (array of structs x, y; last = first), by ray casting."""

    def crosses(i):
        a, b = F.get(ring, i - 1), F.get(ring, i)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.coalesce(crosses(i), F.lit(False)))) % 2 == 1


def tile(lon: Column, lat: Column, z: int) -> Column:
    """struct(x, y) of the web-map tile at zoom z."""
    n = float(2**z)
    r = F.radians(lat)
    top = F.lit(2**z - 1).cast("long")
    clip = lambda v: F.greatest(F.lit(0).cast("long"), F.least(top, F.floor(v)))
    return F.struct(clip((lon + 180.0) / 360.0 * n).alias("x"), clip((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n).alias("y"))


def tile_bounds(x: Column, y: Column, z: int) -> Column:
    """struct(west, south, east, north) in degrees."""
    n = float(2**z)
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * v / n))))
    return F.struct((x / n * 360.0 - 180.0).alias("west"), lat(y + 1).alias("south"), ((x + 1) / n * 360.0 - 180.0).alias("east"), lat(y).alias("north"))


def densify(line: Column, spacing: float) -> Column:
    """Points of a line with others between, none further than `spacing` metres from the next."""

    def between(i):
        a, b = F.get(line, i - 1), F.get(line, i)
        n = F.greatest(F.ceil(haversine(a, b) / spacing).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a["lon"] + (b["lon"] - a["lon"]) * k / n).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * k / n).alias("lat")))

    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.size(line) - 1), between))
    last = F.element_at(line, -1)
    return F.concat(inner, F.array(F.struct(last["lon"].cast("double").alias("lon"), last["lat"].cast("double").alias("lat"))))
