"""Closures against saved routes: which routes a closure lies along, now or as closures arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.matching import aligned, in_cells, line_segments

# Metres between a route and a closure on it, degrees between them, alerts kept for a route.
REACH, BEARING, MOST = 15.0, 30.0, 5


def route_index(routes: DataFrame, reach: float = REACH) -> DataFrame:
    """routes(route, pts) -> (route, cell, qx, qy, rx, ry, at, heading): the routes' segments in cells, made once for a stream."""
    parts = in_cells(line_segments(routes.select(F.col("route").alias("feature"), "pts")), reach, 4 * reach)
    return parts.select(F.col("feature").alias("route"), "cell", F.col("ax").alias("qx"), F.col("ay").alias("qy"), F.col("bx").alias("rx"), F.col("by").alias("ry"), F.col("start").alias("at"), F.col("fheading").alias("heading"))


def _near(px: str, py: str, ax: str, ay: str, bx: str, by: str, reach: float) -> Column:
    dx, dy = F.col(bx) - F.col(ax), F.col(by) - F.col(ay)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col(px) - F.col(ax)) * dx + (F.col(py) - F.col(ay)) * dy) / (dx * dx + dy * dy)))
    ex, ey = F.col(ax) + dx * t - F.col(px), F.col(ay) + dy * t - F.col(py)
    return ex * ex + ey * ey <= reach * reach


def along_routes(closures: DataFrame, index: DataFrame, reach: float = REACH, bearing: float = BEARING) -> DataFrame:
    """closures(closure, pts, any others) with each segment of a route that one of theirs lies along: route and at, metres along
    it. Segments that cross a route, or only end near it at an angle, don't. Works row by row, so on a stream too."""
    others = [c for c in closures.columns if c != "pts"]
    each = closures.where(F.size("pts") >= 2).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("pts") - 1)))
    a, b = F.get("pts", F.col("i") - 1), F.get("pts", F.col("i"))
    each = each.select(*others, a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")).where("ax != bx OR ay != by")
    each = each.withColumn("own", F.pmod(F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))), F.lit(360.0)))
    met = in_cells(each, reach, 4 * reach).join(index, "cell").where(aligned(F.col("own"), F.col("heading"), bearing))
    ends = [("ax", "ay", "qx", "qy", "rx", "ry"), ("bx", "by", "qx", "qy", "rx", "ry"), ("qx", "qy", "ax", "ay", "bx", "by"), ("rx", "ry", "ax", "ay", "bx", "by")]
    near = F.lit(False)
    for e in ends:
        near = near | _near(*e, reach)
    return met.where(near).select(*others, "route", "at")


def alerts(closures: DataFrame, index: DataFrame, now: Column, most: int = MOST) -> DataFrame:
    """closures(closure, start, end, pts) in force at a moment (null ends are open) -> (route, closure, at): the first `most` of
    each route, in the order ridden."""
    live = closures.where((F.col("start").isNull() | (F.col("start") <= now)) & (F.col("end").isNull() | (F.col("end") > now)))
    first = along_routes(live.select("closure", "pts"), index).groupBy("route", "closure").agg(F.min("at").alias("at"))
    n = F.row_number().over(Window.partitionBy("route").orderBy("at", "closure"))
    return first.withColumn("n", n).where(F.col("n") <= most).drop("n")


def alert_stream(closures: DataFrame, index: DataFrame, seen: str, late: str) -> DataFrame:
    """A stream closures(closure, seen timestamp, pts) -> (closure, seen, route): each closure once for each route that it lies
    along, however often it's sent again within `late`; what is remembered ends with the watermark."""
    found = along_routes(closures.select("closure", seen, "pts"), index).drop("at")
    return found.withWatermark(seen, late).dropDuplicatesWithinWatermark(["closure", "route"])
