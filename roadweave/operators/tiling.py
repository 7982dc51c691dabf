"""Map tiles: lines simplified to a zoom, joined where nothing branches, clipped to each tile with a margin.

Coordinates are web-map units from 0 to 1 (x east, y south). A line lies in a tile as points from 0 to 4096, and beyond by the
margin, so that strokes meet at tile edges. Each tile's features are one task's; tiles are bounded by what they draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.routes import simplified
from roadweave.operators.chains import chains
from roadweave.session import cut

EXTENT, MARGIN = 4096, 64
LEAST = {"point": 1, "line": 2, "polygon": 3}  # points of a part


def project(lon: Column, lat: Column) -> Column:
    """(x, y) of degrees in web-map units."""
    r = F.radians(lat)
    return F.struct(((lon + 180.0) / 360.0).alias("x"), ((1.0 - F.log(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0).alias("y"))


def merged_lines(lines: DataFrame, keep: list[str]) -> DataFrame:
    """lines(line long, pts, columns of keep) -> (*keep, pts): lines with equal columns joined where two of them, and
    no other of theirs, meet end to end. A joined line is one row; rings begin at their smallest line."""
    usable = lines.where(F.size("pts") >= 2)
    key = F.struct(*[F.col(c) for c in keep])
    a, z = F.element_at("pts", 1), F.element_at("pts", -1)
    ends = cut(usable.select(key.alias("key"), "line", F.posexplode(F.array(a, z)).alias("side", "node")))
    alone = ends.groupBy("key", "node").agg(F.count("*").alias("n")).where("n = 2").select("key", "node")
    two = ends.join(alone, ["key", "node"])
    other = two.select("key", "node", F.col("line").alias("other"), F.col("side").alias("other_side"))
    pairs = two.join(other, ["key", "node"]).where("line != other OR side != other_side").select("line", "side", "other", "other_side")
    placed = chains(usable.select("line"), pairs)
    run = F.when(F.col("forward"), F.col("pts")).otherwise(F.reverse("pts"))
    whole = usable.join(placed, "line").groupBy("chain", *keep).agg(F.array_sort(F.collect_list(F.struct("place", run.alias("pts")))).alias("parts"))
    inner = F.flatten(F.transform("parts", lambda p: F.slice(p["pts"], 2, F.size(p["pts"]))))
    return whole.select(*keep, F.concat(F.slice(F.get("parts", 0)["pts"], 1, 1), inner).alias("pts"))


def clipped(a: tuple, b: tuple, low: float, high: float) -> tuple[float, float] | None:
    """The part of segment a-b inside the square from low to high, as two places along it from 0 to 1; None if it misses."""
    t0, t1 = 0.0, 1.0
    for p, q in zip(a, b):
        d = q - p
        if d == 0:
            if not low <= p <= high:
                return None
            continue
        s, t = sorted(((low - p) / d, (high - p) / d))
        t0, t1 = max(t0, s), min(t1, t)
    return (t0, t1) if t0 <= t1 else None


def line_parts(points: list[tuple[float, float]], low: float, high: float) -> list[list[tuple[float, float]]]:
    """The parts of a line inside a square, each cut at its edge."""
    parts: list[list[tuple[float, float]]] = []
    for a, b in zip(points, points[1:]):
        span = clipped(a, b, low, high)
        if span is None or (span[0] == span[1] and a != b):
            continue
        p, q = (tuple(u + (v - u) * t for u, v in zip(a, b)) for t in span)
        if parts and parts[-1][-1] == p:
            parts[-1].append(q)
        else:
            parts.append([p, q])
    return parts


def ring_inside(ring: list[tuple[float, float]], low: float, high: float) -> list[tuple[float, float]]:
    """A polygon's ring cut by each side of a square in turn; empty if nothing is left."""
    for axis, edge, keep_above in ((0, low, True), (0, high, False), (1, low, True), (1, high, False)):
        out = []
        for a, b in zip(ring, ring[1:] + ring[:1]):
            ina, inb = ((p[axis] >= edge) == keep_above or p[axis] == edge for p in (a, b))
            if ina:
                out.append(a)
            if ina != inb:
                t = (edge - a[axis]) / (b[axis] - a[axis])
                out.append(tuple(edge if k == axis else u + (v - u) * t for k, (u, v) in enumerate(zip(a, b))))
        ring = out
    return ring


def touched_tiles(features: DataFrame, zoom: int, margin: int = MARGIN) -> DataFrame:
    """features(pts, any others) -> a row for each tile (tx, ty) of the zoom that a segment's own box, widened by the margin,
    touches. A long diagonal line is in the tiles along it, not in all of its box."""
    n, pad = float(2**zoom), margin / EXTENT
    at = lambda v, d: F.greatest(F.lit(0), F.least(F.lit(2**zoom - 1), F.floor(v * n + d)))
    span = lambda a, b: F.sequence(at(F.least(a, b), -pad), at(F.greatest(a, b), pad))
    one = lambda p, q: F.flatten(F.transform(span(p["x"], q["x"]), lambda i: F.transform(span(p["y"], q["y"]), lambda j: F.struct(i.alias("tx"), j.alias("ty")))))
    tiles = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size("pts") - 2, F.lit(0))), lambda i: one(F.get("pts", i), F.coalesce(F.get("pts", i + 1), F.get("pts", i)))))
    box = lambda c, f: f(F.transform("pts", lambda p: p[c]))
    whole = one(F.struct(box("x", F.array_min).alias("x"), box("y", F.array_min).alias("y")), F.struct(box("x", F.array_max).alias("x"), box("y", F.array_max).alias("y")))
    # a polygon also lies in the tiles inside it
    chosen = F.when(F.col("kind") == "polygon", whole).otherwise(F.array_distinct(tiles))
    return features.where(F.size("pts") > 0).withColumn("t", F.explode(chosen)).select("*", "t.tx", "t.ty").drop("t")


def tile_features(features: DataFrame, zoom: int, tolerance: float = 2.0, margin: int = MARGIN) -> DataFrame:
    """features(id long, kind: point, line or polygon, pts array of (x, y) in web-map units, any others) -> (tx, ty, id, kind,
    part, points array of (x, y) in tile units, the others): what of each feature a tile draws. Lines and polygons are
    simplified to `tolerance` tile units first, so low zooms carry few points; a part that shrinks to one place is left
    out, so is a polygon of under three. Points outside the tile itself are left out."""
    others = [c for c in features.columns if c not in ("id", "kind", "pts")]
    rows = touched_tiles(features.select("id", "kind", "pts", *others), zoom, margin)
    n = 2**zoom

    def draw(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                xy = [((p["x"] * n - row.tx) * EXTENT, (p["y"] * n - row.ty) * EXTENT) for p in row.pts]
                low, high = -float(margin), float(EXTENT + margin)
                if row.kind == "point":
                    parts = [[p] for p in xy if 0 <= p[0] < EXTENT and 0 <= p[1] < EXTENT]
                else:
                    stay = simplified(np.array(xy), tolerance)
                    xy = [p for p, s in zip(xy, stay) if s]
                    parts = line_parts(xy, low, high) if row.kind == "line" else [ring_inside(xy[:-1] if xy[0] == xy[-1] else xy, low, high)]
                for k, part in enumerate(parts):
                    whole = [(int(math.floor(x + 0.5)), int(math.floor(y + 0.5))) for x, y in part]
                    thin = [p for i, p in enumerate(whole) if not i or p != whole[i - 1]]
                    if len(thin) >= LEAST[row.kind]:
                        out.append((row.tx, row.ty, row.id, row.kind, k, [{"x": x, "y": y} for x, y in thin], *[getattr(row, c) for c in others]))
            yield pd.DataFrame(out, columns=["tx", "ty", "id", "kind", "part", "points", *others])

    kinds = dict(features.dtypes)
    return rows.mapInPandas(draw, "tx long, ty long, id long, kind string, part int, points array<struct<x: int, y: int>>" + "".join(f", `{c}` {kinds[c]}" for c in others))
