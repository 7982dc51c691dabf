"""Polygons as edges in cells: which areas hold a point, what share of a line they hold, and where a route crosses them.

An area is the edges of all its rings, holes among them, in any order: a point is inside if a ray from it meets an odd number.
Cells of a grid hold, for each area, whether a mark near their middle is inside and the edges that come near. A point is then
tested by the edges between it and the mark of its own cell alone, and a cell without edges needs no test. Points are planar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.matching import in_cells
from roadweave.session import spread

# Metres between samples of a route, reach of an area's edge, shortest shared stretch, shortest crossing.
STEP, REACH, SHARED_RUN, LEAST_CROSSING = 25.0, 2.0, 50.0, 160.9344
#: Where a cell's mark is, on both sides: irrational, so that it isn't level with corners and edges at round places.
MARK = 2**0.5 - 1
EDGE = ("ax", "ay", "bx", "by")


def ring_edges(rings: DataFrame) -> DataFrame:
    """rings(area, pts; closed or not, holes among them) -> (area, ax, ay, bx, by), without edges of no length."""
    nodes = F.when(F.element_at("pts", 1) == F.element_at("pts", -1), F.col("pts")).otherwise(F.concat("pts", F.slice("pts", 1, 1)))
    each = rings.where(F.size("pts") >= 3).select("area", nodes.alias("n")).select("area", "n", F.explode(F.sequence(F.lit(1), F.size("n") - 1)).alias("i"))
    a, b = F.get("n", F.col("i") - 1), F.get("n", F.col("i"))
    return each.select("area", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")).where("ax != bx OR ay != by")


def area_cells(edges: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """edges(area, ax, ay, bx, by) -> (area, cell, inside, edges): cells of side `size` whose mark the area holds, or
    that an edge comes within `reach` of, with those edges. Inner cells come from lines through the marks of a row
    of cells: between one crossing and the next, in order, lie the cells inside."""
    border = in_cells(edges, reach, size).groupBy("area", "cell").agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
    rows = F.sequence(F.ceil(F.least("ay", "by") / size - MARK), F.ceil(F.greatest("ay", "by") / size - MARK) - 1)
    crossed = edges.where(F.ceil(F.least("ay", "by") / size - MARK) < F.ceil(F.greatest("ay", "by") / size - MARK)).withColumn("row", F.explode(rows))
    y = (F.col("row") + MARK) * size
    crossed = crossed.select("area", "row", (F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))).alias("x"))
    order = Window.partitionBy("area", "row").orderBy("x")
    spans = crossed.withColumn("k", F.row_number().over(order)).withColumn("x2", F.lead("x").over(order)).where("k % 2 = 1 AND x2 IS NOT NULL")
    spans = spans.select("area", "row", (F.floor(F.col("x") / size - MARK) + 1).alias("i"), F.floor(F.col("x2") / size - MARK).alias("j")).where("i <= j")
    inner = spans.select("area", "row", F.explode(F.sequence("i", "j")).alias("cx")).select("area", F.struct("cx", F.col("row").alias("cy")).alias("cell"), F.lit(True).alias("inside"))
    both = border.join(inner, ["area", "cell"], "full")
    return both.select("area", "cell", F.coalesce("inside", F.lit(False)).alias("inside"), F.coalesce("edges", F.array().cast("array<struct<ax: double, ay: double, bx: double, by: double>>")).alias("edges"))


def holds(x: Column, y: Column, cell: Column, inside: Column, edges: Column, size: float) -> Column:
    """Whether an area holds a point of the cell: as the cell's mark, changed by each edge between, along the row
    first and then along the column; points on an edge are held."""
    cx, cy = (cell["cx"] + MARK) * size, (cell["cy"] + MARK) * size

    def met(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        at_x = e["ax"] + (cy - e["ay"]) * dx / F.nullif(dy, F.lit(0.0))
        at_y = e["ay"] + (x - e["ax"]) * dy / F.nullif(dx, F.lit(0.0))
        across = ((e["ay"] > cy) != (e["by"] > cy)) & ((at_x < x) != (at_x < cx))
        down = ((e["ax"] > x) != (e["bx"] > x)) & ((at_y < y) != (at_y < cy))
        return F.coalesce(across, F.lit(False)).cast("int") + F.coalesce(down, F.lit(False)).cast("int")

    on = F.exists(edges, lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
    return on | (inside != (F.aggregate(edges, F.lit(0), lambda s, e: s + met(e)) % 2 == 1))


def cell_of(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))


def located(points: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """points(x, y, any others) with each area that holds them, a row each; points outside every area, or without
    coordinates, are left out."""
    met = spread(points).withColumn("cell", cell_of(F.col("x"), F.col("y"), size)).join(cells, "cell")
    return met.where((F.size("edges") == 0) | holds(F.col("x"), F.col("y"), F.col("cell"), F.col("inside"), F.col("edges"), size)).drop("cell", "inside", "edges")


def way_areas(ways: DataFrame, cells: DataFrame, size: float, ranks: DataFrame) -> DataFrame:
    """ways(way, pts), ranks(area, rank) -> (way, area): the area of least rank (then least area) that holds the way's middle point."""
    middle = F.get("pts", F.floor(F.size("pts") / 2).cast("int"))
    points = ways.where(F.size("pts") > 0).select("way", middle["x"].alias("x"), middle["y"].alias("y"))
    best = located(points, cells, size).join(spread(ranks), "area").groupBy("way").agg(F.min(F.struct("rank", "area")).alias("m"))
    return best.select("way", "m.area")


def cut_at_cells(ways: DataFrame, size: float) -> DataFrame:
    """ways(way, pts) -> (way, x0, y0, x1, y1, cell): the ways' segments cut where they leave a cell."""
    each = ways.where(F.size("pts") >= 2).select("way", "pts", F.explode(F.sequence(F.lit(1), F.size("pts") - 1)).alias("i"))
    a, b = F.get("pts", F.col("i") - 1), F.get("pts", F.col("i"))
    seg = each.select("way", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")).where("ax != bx OR ay != by")

    def crossed(p, q):  # where the segment meets the lines of the grid, from 0 to 1
        lo, hi = F.floor(F.least(p, q) / size) + 1, F.ceil(F.greatest(p, q) / size) - 1
        lines = F.when((p != q) & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(lines, lambda k: (k * size - p) / (q - p))

    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), crossed(F.col("ax"), F.col("bx")), crossed(F.col("ay"), F.col("by")))))
    parts = seg.withColumn("t", cuts).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("t") - 1)))
    t0, t1 = F.get("t", F.col("k") - 1), F.get("t", F.col("k"))
    at = lambda c, t: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * t
    mid = (t0 + t1) / 2
    return parts.select("way", at("x", t0).alias("x0"), at("y", t0).alias("y0"), at("x", t1).alias("x1"), at("y", t1).alias("y1"), cell_of(at("x", mid), at("y", mid), size).alias("cell"))


def area_shares(ways: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """ways(way, pts) -> (way, area, share): the share of each way's length inside each area that holds any of it. Pieces
    within a cell are cut where they meet the area's edges there; what lies between is tested by its middle."""
    pieces = spread(cut_at_cells(ways, size))
    x0, y0, dx, dy = F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    length = F.sqrt(dx * dx + dy * dy)
    whole = pieces.groupBy("way").agg(F.sum(length).alias("whole"))

    def where(e):  # the place along the piece where edge e meets it, null if they are parallel
        ex, ey = e["bx"] - e["ax"], e["by"] - e["ay"]
        return ((e["ax"] - x0) * ey - (e["ay"] - y0) * ex) / F.nullif(dx * ey - dy * ex, F.lit(0.0))

    cuts = F.filter(F.transform("edges", where), lambda t: (t > 0) & (t < 1))
    t = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), cuts))
    met = pieces.join(cells, "cell").withColumn("t", F.when(F.size("edges") > 0, t).otherwise(F.array(F.lit(0.0), F.lit(1.0))))

    def part(k):
        a, b = F.get("t", k - 1), F.get("t", k)
        m = (a + b) / 2
        held = F.when(F.size("edges") == 0, F.col("inside")).otherwise(holds(x0 + dx * m, y0 + dy * m, F.col("cell"), F.col("inside"), F.col("edges"), size))
        return F.when((b > a) & held, b - a).otherwise(0.0)

    inside = F.aggregate(F.transform(F.sequence(F.lit(1), F.size("t") - 1), part), F.lit(0.0), lambda s, v: s + v)
    sums = met.groupBy("way", "area").agg(F.sum(inside * length).alias("inside")).where("inside > 0")
    return sums.join(whole, "way").select("way", "area", F.least(F.lit(1.0), F.col("inside") / F.col("whole")).alias("share"))


def route_samples(routes: DataFrame, step: float = STEP) -> DataFrame:
    """routes(route, pts) -> (route, i, x, y, along): the route's points, with others between so that none is further than
    `step` from the next."""
    pts = F.col("pts")

    def between(i):
        a, b = F.get(pts, i - 1), F.get(pts, i)
        n = F.greatest(F.lit(1), F.ceil(F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])) / step).cast("int"))
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct((a["x"] + (b["x"] - a["x"]) * (k / n)).alias("x"), (a["y"] + (b["y"] - a["y"]) * (k / n)).alias("y")))

    first = F.array(F.struct(F.get(pts, 0)["x"].alias("x"), F.get(pts, 0)["y"].alias("y")))
    all_ = F.concat(first, F.flatten(F.transform(F.sequence(F.lit(1), F.size(pts) - 1), between)))
    each = routes.where(F.size(pts) >= 2).select("route", F.posexplode(all_).alias("i", "p")).select("route", "i", "p.x", "p.y")
    w = Window.partitionBy("route").orderBy("i")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    step_m = each.withColumn("m", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return step_m.withColumn("along", F.sum("m").over(w)).drop("m")


def route_crossings(routes: DataFrame, cells: DataFrame, size: float, names: DataFrame, reach: float = REACH, step: float = STEP, least: float = 0.0) -> DataFrame:
    """routes(route, pts), names(area, name, enclave) -> (route, start, end, area, also, enclave): the stretches of each
    route, in its own order, inside an area or within `reach` of it. cells: made with at least that reach.

    A sample belongs to all areas that near, enclaves first, then by name; a stretch is a run of samples of one such list.
    A stretch of several areas shorter than SHARED_RUN is a passing from one to the next: it goes to the stretch
    that follows if they have an area in common, else to the one before. Stretches shorter than `least` are left out
    unless they are enclaves. Stretches of no area are gaps."""
    samples, names = spread(route_samples(routes, step)), spread(names)
    x, y = F.col("x"), F.col("y")

    def near(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / (dx * dx + dy * dy)))
        px, py = e["ax"] + dx * t - x, e["ay"] + dy * t - y
        return px * px + py * py <= reach * reach

    met = samples.withColumn("cell", cell_of(x, y, size)).join(cells, "cell")
    held = F.when(F.size("edges") == 0, F.col("inside")).otherwise(F.exists("edges", near) | holds(x, y, F.col("cell"), F.col("inside"), F.col("edges"), size))
    of = met.where(held).join(names, "area").groupBy("route", "i").agg(F.array_sort(F.collect_set(F.struct((~F.col("enclave")).alias("plain"), "name"))).alias("held"))
    all_ = samples.join(of, ["route", "i"], "left").select("route", "i", "along", F.coalesce(F.col("held.name"), F.array().cast("array<string>")).alias("names"), F.coalesce(F.exists("held", lambda h: ~h["plain"]), F.lit(False)).alias("enclave"))
    w = Window.partitionBy("route").orderBy("i")
    new = F.when(F.lag("names").over(w) == F.col("names"), 0).otherwise(1)
    runs = all_.withColumn("run", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("route", "run", "names").agg(F.min("along").alias("start"), F.max("along").alias("end"), F.bool_or("enclave").alias("enclave"))
    following = F.lead("names").over(Window.partitionBy("route").orderBy("run"))
    listed = runs.withColumn("following", following).groupBy("route").agg(F.array_sort(F.collect_list(F.struct("run", "names", "start", "end", "enclave", "following"))).alias("runs"))
    kept_kind = "array<struct<names: array<string>, start: double, end: double, enclave: boolean>>"

    def fold(s, r):
        start, last = F.coalesce(s["start"], r["start"]), F.get(s["kept"], F.size(s["kept"]) - 1)
        passing = (F.size(r["names"]) > 1) & (r["end"] - start < SHARED_RUN)
        forward = passing & F.coalesce(F.arrays_overlap(r["following"], r["names"]), F.lit(False))
        any_ = F.size(s["kept"]) > 0
        back = any_ & ((passing & F.coalesce(F.arrays_overlap(last["names"], r["names"]), F.lit(False))) | (last["names"] == r["names"]))
        grown = F.concat(F.slice(s["kept"], 1, F.greatest(F.size(s["kept"]) - 1, F.lit(0))), F.array(F.struct(last["names"].alias("names"), last["start"].alias("start"), r["end"].alias("end"), last["enclave"].alias("enclave"))))
        added = F.concat(s["kept"], F.array(F.struct(r["names"].alias("names"), start.alias("start"), r["end"].alias("end"), r["enclave"].alias("enclave"))))
        return F.struct(F.when(forward, s["kept"]).when(back, grown).otherwise(added).cast(kept_kind).alias("kept"), F.when(forward, start).alias("start"))

    begin = F.struct(F.array().cast(kept_kind).alias("kept"), F.lit(None).cast("double").alias("start"))
    told = listed.select("route", F.explode(F.aggregate("runs", begin, fold)["kept"]).alias("c"))
    found = told.where(F.size("c.names") > 0).select("route", "c.start", "c.end", F.get("c.names", 0).alias("area"), F.get("c.names", 1).alias("also"), "c.enclave")
    return found.where(F.col("enclave") | (F.col("end") - F.col("start") >= least))
