"""Rows written for a way, found again after the map has changed: by a stored line, name and class.

A row keeps the fingerprint of its way. Ways that may stand for it now are met in cells around its line, measured
both ways by samples (how much of the way lies on the line, how much of the line the ways cover), and taken only
where they are one answer. Split, merged, redrawn and retagged ways are told apart. Coordinates are planar metres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.tags import street_key
from roadweave.operators.matching import in_cells, line_segments, near_lines, way_probes
from roadweave.session import cut_spread as cut
from roadweave.session import spread

# Metres of tolerance, shares, metres between samples, side by side, degrees, lengths, neighbours.
TOLERANCE, CONTAINED, COVERED, SAMPLE = 6.0, 0.9, 0.9, 2.0
PARALLEL_TOLERANCES, PARALLEL_SHARE, BEARING, LENGTH_RATIO, CHORD, NEIGHBOUR_TOLERANCES = 2.5, 0.5, 30.0, 1.25, 2.0, 1.25


def _metres(a: Column, b: Column) -> Column:
    return F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))


def line_length(pts: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.size(pts) - 1), F.lit(0.0), lambda s, i: s + _metres(F.get(pts, i - 1), F.get(pts, i)))


def place_along(p: Column, pts: Column) -> Column:
    """Metres along a line of the point nearest to p, however far."""

    def step(s, i):
        a, b = F.get(pts, i - 1), F.get(pts, i)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
        ex, ey, m = a["x"] + dx * t - p["x"], a["y"] + dy * t - p["y"], F.sqrt(dx * dx + dy * dy)
        nearer = ex * ex + ey * ey < s["d2"]
        return F.struct((s["run"] + m).alias("run"), F.when(nearer, ex * ex + ey * ey).otherwise(s["d2"]).alias("d2"), F.when(nearer, s["run"] + m * t).otherwise(s["at"]).alias("at"))

    begin = F.struct(F.lit(0.0).alias("run"), F.lit(float("inf")).alias("d2"), F.lit(0.0).alias("at"))
    return F.aggregate(F.sequence(F.lit(1), F.size(pts) - 1), begin, step)["at"]


def point_at(pts: Column, along: Column) -> Column:
    """The point of a line at some metres along it; its last beyond its end."""

    def step(s, i):
        a, b = F.get(pts, i - 1), F.get(pts, i)
        m = _metres(a, b)
        t = (along - s["run"]) / F.nullif(m, F.lit(0.0))
        here = s["x"].isNull() & (m > 0) & (s["run"] + m >= along)
        return F.struct((s["run"] + m).alias("run"), F.when(here, a["x"] + (b["x"] - a["x"]) * t).otherwise(s["x"]).alias("x"), F.when(here, a["y"] + (b["y"] - a["y"]) * t).otherwise(s["y"]).alias("y"))

    none = F.lit(None).cast("double")
    found = F.aggregate(F.sequence(F.lit(1), F.size(pts) - 1), F.struct(F.lit(0.0).alias("run"), none.alias("x"), none.alias("y")), step)
    last = F.element_at(pts, -1)
    return F.struct(F.coalesce(found["x"], last["x"]).alias("x"), F.coalesce(found["y"], last["y"]).alias("y"))


def measured(pairs: DataFrame, rows: DataFrame, ways: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """pairs(row, way) -> ((row, way, near, samples): samples of the way within tolerance of the row's line; (row, way, slot,
    probes): samples of the line within tolerance of the way)."""
    rows, ways = spread(rows), spread(ways)
    one, line = ways.join(pairs.select("way").distinct(), "way", "left_semi").select("way", "pts"), rows.join(pairs.select("row").distinct(), "row", "left_semi").select("row", "pts")
    probes = way_probes(one, SAMPLE)
    size = probes.where("slot = 0").select("way", F.col("probes").alias("samples"))
    of_way = near_lines(probes, line_segments(line.withColumnRenamed("row", "feature")), tolerance).groupBy("way", F.col("feature").alias("row")).agg(F.count("*").alias("near"))
    counted = pairs.select("row", "way").join(size, "way").join(of_way, ["row", "way"], "left").fillna(0, ["near"])
    of_line = near_lines(way_probes(line.withColumnRenamed("row", "way"), SAMPLE), line_segments(one.withColumnRenamed("way", "feature")), tolerance)
    slots = of_line.select(F.col("way").alias("row"), F.col("feature").alias("way"), "slot", "probes").join(pairs.select("row", "way"), ["row", "way"])
    return cut(counted), cut(slots)


def drifted(rows: DataFrame, ways: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Rows whose way is still there -> (row, drift): null where it is the way they were written for; tags: the same line under
    another name or class; split and merged: much shorter or longer; redrawn: about as long, elsewhere."""
    rows, ways = spread(rows), spread(ways)
    own = rows.where("pts IS NOT NULL").join(ways.select("way", F.col("pts").alias("now"), F.col("name").alias("now_name"), F.col("highway").alias("now_highway")), "way")
    counted, slots = measured(own.select("row", "way"), rows, ways, tolerance)
    covers = slots.groupBy("row").agg(F.countDistinct("slot").alias("held"), F.first("probes").alias("all"))
    told = own.join(counted.select("row", "near", "samples"), "row", "left").join(covers, "row", "left")
    lies = F.coalesce((F.col("near") >= CONTAINED * F.col("samples")) & (F.col("held") >= COVERED * F.col("all")), F.lit(False))
    same = street_key(F.col("name")).eqNullSafe(street_key(F.col("now_name"))) & F.col("highway").eqNullSafe(F.col("now_highway"))
    long_ = line_length(F.col("now"))
    kind = F.when(lies, F.when(~same, "tags")).when(long_ < F.col("length") / LENGTH_RATIO, "split").when(long_ > F.col("length") * LENGTH_RATIO, "merged").otherwise("redrawn")
    return told.select("row", kind.alias("drift"))


def standing_for(rows: DataFrame, ways: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """rows(row, name, highway, length, pts), ways(way, name, highway, pts) -> (row, ways, reason): the ways that now stand for a
    row's line, sorted, or why there is no one answer: overreach, none, uncovered, crosses, parallel or length."""
    rows, ways, size = spread(rows), spread(ways), 4 * tolerance
    lines = in_cells(line_segments(rows.select(F.col("row").alias("feature"), "pts")), tolerance, size).select(F.col("feature").alias("row"), "cell").distinct()
    around = in_cells(line_segments(ways.select(F.col("way").alias("feature"), "pts")), tolerance, size).select(F.col("feature").alias("way"), "cell").distinct()
    key = lambda df, i: df.select(i, street_key(F.col("name")).alias("key"), F.coalesce("highway", F.lit("")).alias("class"))
    named = lines.join(around, "cell").select("row", "way").distinct().join(key(rows, "row"), "row").join(key(ways, "way").toDF("way", "key2", "class2"), "way")
    pairs = cut(named.where(F.col("key").eqNullSafe(F.col("key2")) & (F.col("class") == F.col("class2"))).select("row", "way"))
    counted, slots = measured(pairs, rows, ways, tolerance)
    lies = F.col("near") >= CONTAINED * F.col("samples")
    over = counted.where(~lies & (F.col("near") * SAMPLE > NEIGHBOUR_TOLERANCES * tolerance)).select("row").distinct().withColumn("over", F.lit(True))
    held = cut(counted.where(lies).select("row", "way"))
    covered = slots.join(held, ["row", "way"], "left_semi").groupBy("row").agg((F.countDistinct("slot") / F.first("probes")).alias("covered"))
    each = held.join(rows.select("row", "pts", "length"), "row").join(ways.select("way", F.col("pts").alias("w")), "way")
    a, z = F.element_at("w", 1), F.element_at("w", -1)
    each = each.withColumns({"p": place_along(a, F.col("pts")), "q": place_along(z, F.col("pts")), "m": line_length(F.col("w"))}).withColumns({"lo": F.least("p", "q"), "hi": F.greatest("p", "q")})
    s, t = point_at(F.col("pts"), F.col("lo")), point_at(F.col("pts"), F.col("hi"))
    run = _metres(s, t)
    cosine = F.when(run > 0, F.abs((z["x"] - a["x"]) * (t["x"] - s["x"]) + (z["y"] - a["y"]) * (t["y"] - s["y"])) / (_metres(a, z) * F.nullif(run, F.lit(0.0)))).otherwise(0.0)
    each = cut(each.withColumn("crosses", (_metres(a, z) >= CHORD) & (F.degrees(F.acos(F.least(F.lit(1.0), cosine))) > BEARING)).select("row", "way", "length", "lo", "hi", "m", "crosses"))
    x, y = each.select("row", "way", "lo", "hi"), each.select("row", F.col("way").alias("way2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    beside = x.join(y, "row").where("way < way2").where(F.least("hi", "hi2") - F.greatest("lo", "lo2") > F.least(F.lit(PARALLEL_TOLERANCES * tolerance), PARALLEL_SHARE * F.least(F.col("hi") - F.col("lo"), F.col("hi2") - F.col("lo2"))))
    sums = each.groupBy("row").agg(F.sum("m").alias("total"), F.bool_or("crosses").alias("crosses"), F.array_sort(F.collect_list("way")).alias("ways"))
    told = rows.select("row", "length").join(over, "row", "left").join(sums, "row", "left").join(covered, "row", "left").join(beside.select("row").distinct().withColumn("beside", F.lit(True)), "row", "left")
    fits = F.col("total").between(F.col("length") / LENGTH_RATIO, F.col("length") * LENGTH_RATIO)
    reason = F.when(F.col("over"), "overreach").when(F.col("ways").isNull(), "none").when(F.coalesce("covered", F.lit(0.0)) < COVERED, "uncovered").when(F.col("crosses"), "crosses").when(F.col("beside"), "parallel").when(~fits, "length")
    return told.select("row", F.when(reason.isNull(), F.col("ways")).alias("ways"), reason.alias("reason"))


def rematch(rows: DataFrame, ways: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """rows(row long, kind, way long, value, name, highway, length, pts; the last four of its fingerprint, pts null for none;
    warns: whether it may stay on a merged way), ways(way long, name, highway, pts) -> (report(row, outcome, ways, reason),
    applied(row, kind, way, value)).

    A row whose way is gone, or a piece of what it was, goes to the ways that stand for its line now: rematched, or
    covered where each carries an equal row already, or failed. A row of a piece that can't be rematched, and one whose
    way was redrawn or retagged, stays where it is: drifted. One whose way was merged into a longer one isn't applied: failed,
    unless it warns. Rows that would put two values of a kind on one way fail. A row without a fingerprint stays while
    its way does. Rows repeated under one number count once; an empty table gives empty ones."""
    rows, ways = rows.dropDuplicates(["row"]), spread(ways)
    warns = F.coalesce(F.col("warns"), F.lit(False)) if "warns" in rows.columns else F.lit(False)
    rows = cut(rows.withColumn("warns", warns))
    here = cut(rows.join(ways.select("way"), "way", "left_semi").select("row", "kind", "way", "value"))
    drift = drifted(rows, ways, tolerance)
    state = cut(rows.select("row", "kind", "way", "value", "warns", "pts").join(here.select("row", F.lit(True).alias("here")), "row", "left").join(drift, "row", "left").withColumn("here", F.coalesce("here", F.lit(False))))
    pending = state.where("NOT here OR drift = 'split'")
    found = cut(standing_for(rows.join(pending.where("pts IS NOT NULL").select("row"), "row", "left_semi"), ways, tolerance))
    tried = cut(pending.select("row", "kind", "way", "value", "here", F.col("pts").isNull().alias("bare")).join(found, "row", "left"))
    tried = tried.withColumn("reason", F.when(F.col("bare"), "no fingerprint").when(F.col("here") & F.col("ways").isNotNull() & ~F.array_contains("ways", F.col("way")), "leaves its piece out").otherwise(F.col("reason")))
    claims = cut(tried.where("reason IS NULL").select("row", "kind", "value", F.explode("ways").alias("to")))
    # another row's value on the same way: of a row that is there, or of one that would come
    there = here.select(F.col("row").alias("other"), "kind", F.col("way").alias("to"), F.col("value").alias("v2"))
    rivals = there.unionByName(claims.select(F.col("row").alias("other"), "kind", "to", F.col("value").alias("v2")))
    clash = claims.join(rivals, ["kind", "to"]).where(F.col("row") != F.col("other")).where(~F.col("value").eqNullSafe(F.col("v2"))).select("row").distinct()
    taken = claims.join(clash, "row", "left_anti").join(here.select("kind", F.col("way").alias("to"), F.lit(True).alias("held")).distinct(), ["kind", "to"], "left")
    new = cut(taken.where("held IS NULL").select("row", "kind", "to", "value"))
    judged = tried.join(clash.withColumn("clash", F.lit(True)), "row", "left").join(new.select("row").distinct().withColumn("moves", F.lit(True)), "row", "left")
    reason = F.coalesce("reason", F.when(F.col("clash"), "another value there"))
    outcome = F.when(reason.isNotNull(), F.when(F.col("here"), "drifted").otherwise("failed")).when(F.col("moves"), "rematched").otherwise("covered")
    report = judged.select("row", outcome.alias("outcome"), F.when(reason.isNull(), F.col("ways")).when(F.col("here"), F.array("way")).alias("ways"), F.coalesce(reason, F.when(F.col("here"), "split")).alias("reason"))
    rest = state.where("here AND drift IS NOT NULL AND drift != 'split'")
    barred = (F.col("drift") == "merged") & ~F.col("warns")
    report = report.unionByName(rest.select("row", F.when(barred, "failed").otherwise("drifted").alias("outcome"), F.when(~barred, F.array("way")).alias("ways"), F.col("drift").alias("reason")))
    stay = here.join(state.where(F.coalesce(barred, F.lit(False))).select("row"), "row", "left_anti")
    moved = new.groupBy("kind", F.col("to").alias("way")).agg(F.min("row").alias("row"), F.first("value").alias("value"))
    return report, stay.select("row", "kind", "way", "value").unionByName(moved.select("row", "kind", "way", "value"))
