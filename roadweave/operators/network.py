"""Networks of ways: vertices, connected pieces and their sums, dead ends, and the cheapest links between pieces.

Rounds of joins take the place of walks: distances spread from all pieces at once, an edge a round, and pieces are joined by
Borůvka's rounds, each piece taking its cheapest link. Every round's tables are cut, so no plan grows with the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.chains import chains
from roadweave.operators.graph import components
from roadweave.session import cut, spread


def vertices(points: DataFrame, least: int = 2) -> DataFrame:
    """points(line, i, node, step: metres from the point before, not read of the first) -> (line, i, node, along): each
    line's ends and the nodes that `least` lines or more share, with the metres along the line. Nodes are counted by
    lines, so one on which a line lies twice isn't shared by that."""
    w = Window.partitionBy("line")
    shared = points.groupBy("node").agg(F.countDistinct("line").alias("n")).where(F.col("n") >= least).select("node", F.lit(True).alias("shared"))
    told = points.withColumns({"first": F.min("i").over(w), "last": F.max("i").over(w)})
    told = told.withColumn("along", F.sum(F.when(F.col("i") == F.col("first"), 0.0).otherwise(F.col("step"))).over(w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return told.join(shared, "node", "left").where("i = first OR i = last OR shared").select("line", "i", "node", "along")


def pieces(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (node, piece): connected pieces, each by its smallest node. Nodes of loops alone are pieces too."""
    of = components(edges.select("u", "v")).select("node", F.col("component").alias("piece"))
    alone = edges.where("u = v").select(F.col("u").alias("node")).distinct().join(of, "node", "left_anti")
    return of.unionByName(alone.select("node", F.col("node").alias("piece")))


def piece_sums(edges: DataFrame, of: DataFrame, value: str = "cost") -> DataFrame:
    """(piece, rows, total) of the edges of each piece."""
    return edges.join(of, edges["u"] == of["node"]).groupBy("piece").agg(F.count("*").alias("rows"), F.sum(value).alias("total"))


def spurs(edges: DataFrame, least: float) -> DataFrame:
    """edges(row long, u, v, cost) -> (row): dead ends shorter than `least`, from an open end to the first node of three
    edges or more; what becomes a dead end when they are gone counts too. Pieces without such a node stay whole, and so do
    dead ends of `least` or more. A round takes whole chains off, so their number is that of the nodes met on the way in, and
    the next reads each chain that is left as one edge."""
    live, levels = cut(edges.select("row", "u", "v", "cost").dropDuplicates(["row"])), []
    while True:
        ends = live.select(F.col("row").alias("line"), F.posexplode(F.array("u", "v")).alias("side", "node"))
        degree = cut(ends.groupBy("node").agg(F.count("*").alias("n")))
        two = ends.join(spread(degree.where("n = 2").select("node")), "node")
        other = two.select("node", F.col("line").alias("other"), F.col("side").alias("other_side"))
        pairs = spread(two).join(other, "node").where("line != other OR side != other_side").select("line", "side", "other", "other_side")
        placed = cut(chains(live.select(F.col("row").alias("line")), pairs).where("NOT ring").select("line", "chain"))
        # from here on a chain is one edge between the nodes at its two ends; rings touch nothing else
        met = ends.join(spread(degree.where("n != 2")), "node").join(spread(placed), "line")
        tips = met.groupBy("chain").agg(F.min("node").alias("u"), F.max("node").alias("v"), F.sum((F.col("n") == 1).cast("int")).alias("open"), F.sum((F.col("n") > 2).cast("int")).alias("joints"))
        size = live.select(F.col("row").alias("line"), "cost").join(spread(placed), "line").groupBy("chain").agg(F.sum("cost").alias("cost"))
        short = F.coalesce((F.col("open") == 1) & (F.col("joints") == 1) & (F.col("cost") < least), F.lit(False))
        whole = cut(size.join(spread(tips), "chain").select(F.col("chain").alias("row"), "u", "v", "cost", short.alias("short")))
        off = whole.where("short").select("row")
        levels.append((placed, off))
        if off.isEmpty():
            break
        live = whole.where("NOT short").drop("short")
    gone = None
    for placed, off in reversed(levels):  # the edges that make up the chains taken off
        held = off if gone is None else off.unionByName(gone)
        gone = placed.join(held.select(F.col("row").alias("chain")), "chain", "left_semi").select(F.col("line").alias("row"))
    return gone


def reached(edges: DataFrame, of: DataFrame, limit: float) -> DataFrame:
    """edges(row, u, v, cost), of(node, piece) -> (node, d, piece, via, back): the nearest piece of every node within `limit`
    of one, with the edge and the node that lead there (null inside a piece). Ties: the smaller piece, edge."""
    both = edges.select("row", "u", "v", "cost").unionByName(edges.select("row", F.col("v").alias("u"), F.col("u").alias("v"), "cost")).where("u != v")
    none = F.lit(None).cast("long")
    known = cut(of.select("node", F.struct(F.lit(0.0).alias("d"), "piece", none.alias("via"), none.alias("back")).alias("b")))
    fresh = known
    while not fresh.isEmpty():
        step = fresh.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node"), F.struct((F.col("b.d") + F.col("cost")).alias("d"), F.col("b.piece").alias("piece"), F.col("row").alias("via"), F.col("u").alias("back")).alias("b")).where(F.col("b.d") <= limit)
        found = step.groupBy("node").agg(F.min("b").alias("new"))
        merged = known.join(found, "node", "full")
        better = F.col("new").isNotNull() & (F.col("b").isNull() | (F.struct("new.d", "new.piece") < F.struct("b.d", "b.piece")))
        now = cut(merged.select("node", F.when(better, F.col("new")).otherwise(F.col("b")).alias("b"), better.alias("better")))
        known, fresh = now.select("node", "b"), now.where("better").select("node", "b")
    return known.select("node", "b.d", "b.piece", "b.via", "b.back")


def cheapest_forest(links: DataFrame) -> DataFrame:
    """links(a, b, rank: orderable, no two alike, any others) -> those of the minimum spanning forest of the pieces a and b, by
    Borůvka's rounds: each group takes its least link out, and the groups so joined are one in the next."""
    live, taken = cut(links.where("a != b").withColumns({"ga": F.col("a"), "gb": F.col("b")})), None
    while not live.isEmpty():
        out = live.select("rank", F.explode(F.array("ga", "gb")).alias("g")).groupBy("g").agg(F.min("rank").alias("rank"))
        chosen = cut(live.join(out.select("rank").distinct(), "rank", "left_semi"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        group = cut(components(chosen.select(F.col("ga").alias("u"), F.col("gb").alias("v"))))
        a, b = group.toDF("ga", "na"), group.toDF("gb", "nb")
        moved = live.join(a, "ga", "left").join(b, "gb", "left").withColumns({"ga": F.coalesce("na", "ga"), "gb": F.coalesce("nb", "gb")}).drop("na", "nb").where("ga != gb")
        # between two groups only the least link matters
        least = moved.groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.min("rank").alias("rank")).select("rank")
        live = cut(moved.join(least, "rank", "left_semi"))
    return (links.where("1 = 0") if taken is None else taken.drop("ga", "gb"))


def connected(edges: DataFrame, of: DataFrame, inside: DataFrame, limit: float, least: float) -> DataFrame:
    """edges(row, u, v, cost) outside the network, of(node, piece), inside(row, u, v, cost) its own -> (row): the edges of the
    cheapest links, of cost up to `limit`, that join its pieces, kept where the pieces joined are `least` long or more together.

    Costs spread from all pieces at once; where two spreads meet at an edge is a link, and the cheapest forest of these
    holds every piece's way to its nearest other piece. A link's edges are read back along both spreads, an edge a round."""
    near = cut(reached(edges, of, limit))
    at = lambda k: near.select(F.col("node").alias(k), F.col("d").alias(f"d{k}"), F.col("piece").alias(f"p{k}"))
    met = edges.select("row", "u", "v", "cost").join(at("u"), "u").join(at("v"), "v").where("pu != pv").withColumn("whole", F.col("du") + F.col("cost") + F.col("dv")).where(F.col("whole") <= limit)
    low, high = F.least("pu", "pv"), F.greatest("pu", "pv")
    links = met.groupBy(low.alias("a"), high.alias("b")).agg(F.min(F.struct("whole", "row", "u", "v")).alias("m"))
    links = links.select("a", "b", F.struct("m.whole", "a", "b").alias("rank"), "m.row", "m.u", "m.v")
    forest = cut(cheapest_forest(links))
    joined = components(forest.select(F.col("a").alias("u"), F.col("b").alias("v"))).toDF("piece", "group")
    total = piece_sums(inside, of).join(joined, "piece", "left").groupBy(F.coalesce("group", "piece").alias("group")).agg(F.sum("total").alias("total")).where(F.col("total") >= least)
    kept = cut(forest.join(joined, forest["a"] == joined["piece"]).join(total, "group", "left_semi").select("row", "u", "v"))
    rows, walk = kept.select("row"), cut(kept.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    while not walk.isEmpty():
        back = cut(walk.join(near.where("via IS NOT NULL"), "node").select(F.col("via").alias("row"), F.col("back").alias("node")))
        rows, walk = rows.unionByName(back.select("row")), cut(back.select("node").distinct())
    return rows.distinct()
