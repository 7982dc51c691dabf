"""Lines joined end to end: partners at nodes, and the order of lines along a chain of any length.

The order is found by pointer jumping: each line knows the one before it, then the one two before, four before and so on,
so a chain of n lines takes log2(n) rounds of one equi-join, and no task holds a whole chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.graph import mutual_best
from roadweave.session import cut, shares, spread

STRAIGHT = 45.0  # degrees off straight on that still continue a line


def partners(ends: DataFrame, limit: float = STRAIGHT) -> DataFrame:
    """ends(node, line, side 0 or 1, heading away from the node) -> (line, side, other, other_side), both ways round: ends
    at one node joined by good continuity, straightest first, ties by line and side; a line's own ends never join.

    A round takes the pairs that are each other's best and leaves the rest, which equals taking all pairs in order. It
    emits the pairs of a node, whose number is the square of its degree."""
    a = ends.select("node", F.col("line").alias("a"), F.col("side").alias("a_side"), F.col("heading").alias("ah"))
    b = ends.select("node", F.col("line").alias("b"), F.col("side").alias("b_side"), F.col("heading").alias("bh"))
    off = F.abs(F.abs(F.pmod(F.col("ah") - F.col("bh") + 180.0, F.lit(360.0)) - 180.0) - 180.0)
    pairs = a.join(b, "node").where("a != b").withColumn("off", off).where(F.col("off") <= limit)
    low, high = F.struct(F.col("a").alias("l"), F.col("a_side").alias("s")), F.struct(F.col("b").alias("l"), F.col("b_side").alias("s"))
    open_ = cut(pairs.select(low.alias("p"), high.alias("q"), "off"))
    order, found = ["off", F.least("p", "q"), F.greatest("p", "q")], None
    while not open_.isEmpty():
        best = cut(mutual_best(open_, "p", "q", order))
        found = best if found is None else found.unionByName(best)
        gone = best.select(F.col("p").alias("gone"))
        open_ = cut(open_.join(gone, F.col("p") == F.col("gone"), "left_anti").join(gone, F.col("q") == F.col("gone"), "left_anti"))
    found = open_ if found is None else found
    return found.select(F.col("p.l").alias("line"), F.col("p.s").alias("side"), F.col("q.l").alias("other"), F.col("q.s").alias("other_side"))


def chains(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """lines(line long), pairs(line, side, other, other_side; both ways round, an end at most once) -> (line, chain, place,
    forward, ring): every line in one chain, numbered from 0 along it. chain: the line at its head. forward: whether the
    chain runs from the line's side 0 to its side 1. A chain is told from its end of the smaller line, a ring from its
    smallest line. Lines without pairs are chains of one."""
    # a state is a line run one way: 2 * line, plus 1 if it is entered at side 1
    state = lambda line, side: 2 * F.col(line) + F.col(side)
    before = pairs.select(state("line", "side").alias("s"), (2 * F.col("other") + 1 - F.col("other_side")).alias("ptr"))
    states = lines.select(F.explode(F.array(2 * F.col("line"), 2 * F.col("line") + 1)).alias("s")).join(before, "s", "left")
    # jump: steps to ptr, or to the head where ptr is null; least: the least state among those passed, `at` steps back
    at_head = F.col("ptr").isNull()
    now = states.select("s", "ptr", F.when(at_head, 0).otherwise(1).cast("long").alias("jump"), F.when(at_head, F.col("s")).alias("root"), F.col("s").alias("least"), F.lit(0).cast("long").alias("at"))
    open_, done, seen = cut(now), None, None
    deal = shares(lines.sparkSession, open_.count())
    while True:
        # states at their head are done: they are jumped to, and jump no more
        fixed = open_.where("ptr IS NULL")
        done, open_ = fixed if done is None else done.unionByName(fixed), open_.where("ptr IS NOT NULL")
        told = tuple(open_.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(s, least))"), F.lit(0))).first())
        if not told[0] or told == seen:
            break
        seen = told
        ahead = done.unionByName(open_).select(F.col("s").alias("ptr"), F.col("ptr").alias("p2"), F.col("jump").alias("j2"), F.col("root").alias("r2"), F.col("least").alias("l2"), F.col("at").alias("a2"))
        less = F.col("l2") < F.col("least")
        open_ = cut(spread(open_.repartition(deal, "ptr")).join(spread(ahead.repartition(deal, "ptr")), "ptr", "left").select(
            "s", F.col("p2").alias("ptr"), (F.col("jump") + F.coalesce("j2", F.lit(0))).alias("jump"), F.coalesce("root", "r2").alias("root"),
            F.when(less, F.col("l2")).otherwise(F.col("least")).alias("least"), F.when(less, F.col("jump") + F.col("a2")).otherwise(F.col("at")).alias("at"),
        ))
    now = done.unionByName(open_)
    ring = F.col("ptr").isNotNull()
    placed = now.select(F.floor(F.col("s") / 2).alias("line"), F.struct(F.when(ring, F.col("least")).otherwise(F.col("root")).alias("root"), (F.col("s") % 2 == 1).alias("back"), F.when(ring, F.col("at")).otherwise(F.col("jump")).alias("place"), ring.alias("ring")).alias("c"))
    best = placed.groupBy("line").agg(F.min("c").alias("c"))
    return best.select("line", F.floor(F.col("c.root") / 2).alias("chain"), "c.place", (~F.col("c.back")).alias("forward"), "c.ring")


def line_ends(lines: DataFrame, reach: float = 30.0) -> DataFrame:
    """lines(line, pts array of (x, y)) -> (node, line, side, heading): each end with its place as node, and the bearing
    away from it, read at the first point `reach` or more along the line, or at the other end."""
    metres = lambda a, b: F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))

    def told(pts: Column, side: int) -> Column:
        def step(s, p):
            run = s["run"] + metres(s["last"], p)
            return F.struct(run.alias("run"), p.alias("last"), F.coalesce(s["to"], F.when(run >= reach, p)).alias("to"))

        start = F.get(pts, 0)
        walk = F.aggregate(pts, F.struct(F.lit(0.0).alias("run"), start.alias("last"), F.when(F.lit(False), start).alias("to")), step)
        to = F.coalesce(walk["to"], walk["last"])
        return F.struct(start.alias("node"), F.lit(side).alias("side"), F.pmod(F.degrees(F.atan2(to["x"] - start["x"], to["y"] - start["y"])), F.lit(360.0)).alias("heading"))

    usable = lines.where(F.size("pts") >= 2)
    both = usable.select("line", F.explode(F.array(told(F.col("pts"), 0), told(F.reverse("pts"), 1))).alias("e"))
    return both.select("e.node", "line", "e.side", "e.heading")


def strokes(lines: DataFrame, limit: float = STRAIGHT, reach: float = 30.0) -> DataFrame:
    """lines(line long, pts) joined into strokes by good continuity: (line, chain, place, forward, ring)."""
    return chains(lines.where(F.size("pts") >= 2).select("line"), partners(line_ends(lines, reach), limit))


def along_chains(lines: DataFrame, placed: DataFrame, length: str = "length") -> DataFrame:
    """placed with start: the metres along its chain at which a line begins. A running sum within each chain."""
    w = Window.partitionBy("chain").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(lines.select("line", length), "line").withColumn("start", F.coalesce(F.sum(length).over(w), F.lit(0.0)))


def closed_rings(ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ways(area, role, way long, a, b; its end nodes) joined end to end: (area, role, ring, place, way, forward) of the
    closed rings, and (area, role, way) of what doesn't close. Ways of one area and role only are joined.

    Dangling chains go first, so a spur doesn't open the ring it hangs on; each round drops whole chains between
    branching nodes, and goes on with the areas and roles that have any. Where four ends or more meet, they pair up by way; an odd one out stays open."""
    live = cut(ways.select("area", "role", "way", "a", "b").distinct())

    def ends(df):
        return df.select("area", "role", F.col("way").alias("line"), F.posexplode(F.array("a", "b")).alias("side", "node"))

    def paired(df, most):
        """Ends of a node two by two; only at nodes of at most `most` ends."""
        at = Window.partitionBy("area", "role", "node")
        n = ends(df).withColumn("n", F.count("*").over(at)).withColumn("k", F.row_number().over(at.orderBy("line", "side")))
        if most:
            n = n.where(F.col("n") <= most)
        x = n.select("area", "role", "node", F.floor((F.col("k") - 1) / 2).alias("two"), "line", "side")
        y = x.select("area", "role", "node", "two", F.col("line").alias("other"), F.col("side").alias("other_side"))
        return x.join(y, ["area", "role", "node", "two"]).where("line != other OR side != other_side").select("line", "side", "other", "other_side")

    def told(live, placed):
        of = live.select("area", "role", "way").join(placed.withColumnRenamed("line", "way"), "way").where("ring")
        return of.select("area", "role", F.col("chain").alias("ring"), "place", "way", "forward")

    rings = None
    while True:
        placed = cut(chains(live.select(F.col("way").alias("line")), paired(live, 2)))
        deg = cut(ends(live).groupBy("area", "role", "node").agg(F.count("*").alias("n")))
        # where no node of an area has three ends, its chains are whole pieces, and nothing that goes changes another
        meets = deg.where("n > 2").select("area", "role").distinct()
        settled = told(live.join(meets, ["area", "role"], "left_anti"), placed)
        rings = settled if rings is None else rings.unionByName(settled)
        live = cut(live.join(meets, ["area", "role"], "left_semi"))
        if live.isEmpty():
            break
        loose = ends(live).join(deg.where("n = 1"), ["area", "role", "node"]).select("line").distinct()
        open_ = placed.join(loose, "line").select("chain").distinct()
        gone = cut(live.select("way").join(placed.where("NOT ring").join(open_, "chain", "left_semi").select(F.col("line").alias("way")), "way", "left_semi"))
        if gone.isEmpty():
            rings = rings.unionByName(told(live, cut(chains(live.select(F.col("way").alias("line")), paired(live, None)))))
            break
        live = cut(live.join(gone, "way", "left_anti"))
    rings = cut(rings)
    return rings, ways.select("area", "role", "way").distinct().join(rings.select("way"), "way", "left_anti")


def ring_points(rings: DataFrame, ways: DataFrame) -> DataFrame:
    """closed_rings' first table, ways(way, pts) -> (area, role, ring, pts) of rings of four points or more, the last point
    being the first. A ring is one row."""
    run = F.when(F.col("forward"), F.col("pts")).otherwise(F.reverse("pts"))
    parts = rings.join(ways.select("way", "pts"), "way").select("area", "role", "ring", F.struct("place", run.alias("pts")).alias("part"))
    whole = parts.groupBy("area", "role", "ring").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    # each part begins where the one before ends
    inner = F.flatten(F.transform("parts", lambda p: F.slice(p["pts"], 2, F.size(p["pts"]))))
    first = F.slice(F.get("parts", 0)["pts"], 1, 1)
    return whole.select("area", "role", "ring", F.concat(first, inner).alias("pts")).where(F.size("pts") >= 4)
