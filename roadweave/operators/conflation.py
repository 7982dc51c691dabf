"""Matching agency records onto ways: candidates by sampled points, a total rank, exclusive stretches.

Claims are greedy by rank. They are decided in rounds of joins: rows that come first
both for their way and on their stretch of the feature hold, their rivals leave, and
the outcome equals one greedy pass over everything.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.graph import components, hub_join
from roadweave.operators.joins import proximity_join
from roadweave.session import cut, dealt, shares, spread, stored

# Metres, share of the way, degrees.
SEPARATION, OVERLAP, BEARING = 20.0, 0.5, 25.0
REUSE = 0.25  # of its own stretch a way may share with one before it
FINISH = 20_000  # rows of claims that one pass decides
WHOLE = 1_000_000  # rows of claims that are decided in one slice
SLICES = (1 / 64, 1 / 16, 1 / 4)  # shares of the rows, by rank, where slices end
SOME = 20_000  # rows that the ends of slices are read from
CELLS = 1_000  # a stretch lies in so many cells at most
BLOCKS = 16  # a stretch lies in so many blocks, but for one or two, at most


def candidates(way_points: DataFrame, feature_points: DataFrame, separation: float = SEPARATION, overlap: float = OVERLAP, bearing: float = BEARING) -> DataFrame:
    """way_points(way, x, y, heading) and feature_points(feature, fx, fy, fheading, along), both sampled at an even
    spacing -> (way, feature, share, lo, hi, apart): the share of the way's points that lie near the feature and
    head its way (either direction), the stretch of the feature they cover, and their mean distance."""
    size = way_points.groupBy("way").agg(F.count("*").alias("points"))
    turn = F.pmod(F.col("heading") - F.col("fheading") + 90.0, F.lit(180.0)) - 90.0
    near = proximity_join(way_points, feature_points, ("x", "y"), ("fx", "fy"), separation, F.abs(turn) <= bearing)
    best = near.groupBy("way", "feature", "x", "y").agg(F.min(F.struct("d2", "along")).alias("b"))
    shares = best.groupBy("way", "feature").agg(F.count("*").alias("n"), F.min("b.along").alias("lo"), F.max("b.along").alias("hi"), F.avg(F.sqrt("b.d2")).alias("apart"))
    found = shares.join(size, "way").withColumn("share", F.col("n") / F.col("points"))
    return found.where(F.col("share") >= overlap).select("way", "feature", "share", "lo", "hi", "apart")


def greedy_claims(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows by rank: a way takes one feature, and no two ways overlapping stretches of one (touching ends are apart)."""
    taken: dict = {}
    done: set = set()
    kept = []
    for r in rows.sort_values(["precedence", "share", "apart", "way", "feature"], ascending=[True, False, True, True, True]).itertuples():
        spans = taken.setdefault(r.feature, [])
        if r.way not in done and not any(r.lo < b and a < r.hi for a, b in spans):
            spans.append((r.lo, r.hi))
            done.add(r.way)
            kept.append(r.Index)
    return rows.loc[kept]


def claim(found: DataFrame, finish: int = FINISH, whole: int = WHOLE) -> DataFrame:
    """(way long, feature long, precedence int, share, lo, hi, apart) -> the rows that hold after exclusive claims.

    More than `whole` rows are decided in slices by rank: what holds of a slice refuses most of the next before a round
    reads it, so that most rows are dealt once. In a slice, a round takes every row of least rank both for its way and in
    every cell of the feature that its stretch touches; cells are as long as the mean stretch. Then the ways taken and the
    stretches that overlap one taken leave. When `finish` rows or fewer are left, one greedy pass decides them.
    """
    last = lambda c, x: [(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"no_{c}"), x.alias(f"by_{c}")]  # noqa: E731  nulls come last
    first = [*last("precedence", F.col("precedence")), *last("share", -F.col("share")), *last("apart", F.col("apart")), "way", "feature"]
    rank = F.struct(*first, *[c for c in found.columns if c not in ("way", "feature", "precedence", "share", "apart")])
    rows = stored(found.distinct())
    length = F.abs(F.col("hi") - F.col("lo")).cast("double")
    length = F.when(placed() & (length < float("inf")), length)
    count, mean, longest = rows.agg(F.count("*"), F.avg(length), F.max(length)).first()
    width = max(mean or 0.0, (longest or 0.0) / CELLS)
    width = width if 0 < width < float("inf") else 1.0
    block = max(width, (longest or 0.0) / BLOCKS)
    held, parts = None, shares(found.sparkSession, count)
    for within in by_slices(rows, F.struct(*first), count, whole):
        live = rows.where(within)
        if held is not None:
            live = unclaimed(live, held, block, longest or 0.0, parts if parts > shares(found.sparkSession, 0) else None)
        taken = in_rounds(live, rank, width, finish, lambda live, taken: unclaimed(live, taken, block, longest or 0.0))
        held = taken if held is None else cut(held.unionByName(taken))
    return held


def placed() -> Column:
    """Whether a stretch has both ends; one that hasn't overlaps none."""
    return F.col("lo").isNotNull() & F.col("hi").isNotNull() & ~F.isnan(F.col("lo").cast("double")) & ~F.isnan(F.col("hi").cast("double"))


def by_slices(rows: DataFrame, rank: Column, count: int, whole: int) -> list[Column]:
    """Conditions that part rows into slices by rank, best first. The ends are read from some rows; wherever they lie, each
    row is in one slice."""
    if count <= whole:
        return [F.lit(True)]
    some = rows.select(rank.alias("rank")).sample(min(1.0, SOME / count), 1).orderBy("rank")
    ranks = [r["rank"] for r in some.collect()]
    ends = [F.struct(*[F.lit(v) for v in ranks[int(len(ranks) * s)]]).cast(some.schema["rank"].dataType) for s in SLICES] if ranks else []
    return [(rank > a if a is not None else F.lit(True)) & (rank <= b if b is not None else F.lit(True)) for a, b in pairwise([None, *ends, None])]


def unclaimed(live: DataFrame, taken: DataFrame, block: float, longest: float, parts: int | None = None) -> DataFrame:
    """live without the ways of taken, and without the stretches that overlap one of taken. A row is looked up in the block
    where its stretch starts; a stretch of taken is in all blocks where one that it overlaps can start. parts: partitions
    that live is dealt to, else the session's."""
    at = lambda f: F.floor(f("lo", "hi") / block)
    deal = lambda df: spread(df.repartition(parts, "feature", "block") if parts else df)
    reach = int(longest / block) + 2
    spans = taken.where(placed()).select("feature", F.explode(F.sequence(at(F.least) - reach, at(F.greatest))).alias("block"), F.struct(F.col("lo").alias("a"), F.col("hi").alias("b")).alias("span"))
    spans = deal(spans).groupBy("feature", "block").agg(F.collect_set("span").alias("spans"))
    over = placed() & F.exists("spans", lambda s: (F.col("lo") < s["b"]) & (s["a"] < F.col("hi")))
    free = deal(live.withColumn("block", at(F.least))).join(spans, ["feature", "block"], "left").where(~F.coalesce(over, F.lit(False)))
    return free.select(*live.columns).join(spread(taken.select("way")), "way", "left_anti")


def in_rounds(live: DataFrame, rank: Column, width: float, finish: int, leave: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The rows of live that hold among these; leave(live, taken): those that are left when some are taken."""
    cell = lambda f: F.floor(f("lo", "hi") / width)
    columns, kinds = live.columns, ", ".join(f"{c} {t}" for c, t in live.dtypes)
    live, held = cut(live.withColumn("id", F.monotonically_increasing_id())), []
    while (left := live.count()) > finish:
        # rows go by their number; a rank is read where rows are compared
        size = cell(F.greatest) - cell(F.least) + 1
        in_cells = live.where(placed()).select("feature", "id", rank.alias("rank"), size.alias("n"), F.explode(F.sequence(cell(F.least), cell(F.greatest))).alias("cell"))
        of_cell = in_cells.groupBy("feature", "cell").agg(F.min(F.struct("rank", "id", "n")).alias("m"))
        on_feature = of_cell.groupBy("m.id", "m.n").agg(F.count("*").alias("c")).where("c >= n").select("id").unionByName(live.where(~placed()).select("id"))
        of_way = live.groupBy("way").agg(F.min(F.struct(rank.alias("rank"), "id")).alias("m")).select("m.id")
        taken = cut(live.join(of_way.join(on_feature, "id"), "id", "left_semi"))
        held.append(taken.select(*columns))
        live = cut(leave(live, taken))
    if left:
        rest = live.select(*columns).withColumn("__all", F.lit(0))
        held.append(cut(rest.groupBy("__all").applyInPandas(lambda pdf: greedy_claims(pdf)[columns], kinds)))
    return reduce(DataFrame.unionByName, held) if held else live.select(*columns)


def greedy_spans(rows: pd.DataFrame, reuse: float) -> pd.DataFrame:
    """Rows in the order of `place`: one for each owner, and none of which a stretch lies over one before it by more than
    `reuse` of its own length."""
    taken: dict = {}
    done: set = set()
    kept = []
    for i, owner, spans in zip(rows.index, rows["owner"], rows["spans"]):
        fits = all(min(s["hi"], b) - max(s["lo"], a) <= max(0.0, reuse * (s["hi"] - s["lo"])) for s in spans for a, b in taken.get(s["feature"], ()))
        if owner not in done and fits:
            done.add(owner)
            kept.append(i)
            for s in spans:
                taken.setdefault(s["feature"], []).append((s["lo"], s["hi"]))
    return rows.loc[kept]


def exclusive(found: DataFrame, reuse: float = REUSE, held: DataFrame | None = None, finish: int = FINISH) -> DataFrame:
    """found(owner, rank, spans array of (feature, lo, hi), any others) -> the rows that hold after greedy claims by rank
    (any orderable value, no two rows alike): an owner takes one row, a row takes all its stretches or is refused, and it
    is refused where a stretch lies over one taken before by more than `reuse` of its own length. held(owner, spans):
    what is taken already. Rows without stretches are refused.

    In rounds, as `claim`: rows of least rank for their owner and in every cell that they touch hold, then the owners
    taken and the rows refused for them leave. When `finish` rows or fewer are left, one pass decides them.
    """
    size = found.select(F.explode("spans").alias("s")).agg(F.avg(F.col("s.hi") - F.col("s.lo")), F.max(F.col("s.hi") - F.col("s.lo"))).first()
    width = max(size[0] or 0.0, (size[1] or 0.0) / CELLS) or 1.0
    cells = lambda lo, hi: F.sequence(F.floor(lo / width), F.floor(hi / width))
    touched = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.transform(cells(s["lo"], s["hi"]), lambda c: F.struct(s["feature"].alias("feature"), c.alias("cell"))))))

    def by_cell(df):
        return df.select("rank" if "rank" in df.columns else F.lit(0), F.explode("spans").alias("s")).select("*", F.explode(cells(F.col("s.lo"), F.col("s.hi"))).alias("cell"))

    def left_by(live, taken):
        """live without the owners of taken, and without the rows that its stretches refuse."""
        over = by_cell(taken.select("spans")).select(F.col("s.feature").alias("feature"), "cell", F.col("s.lo").alias("a"), F.col("s.hi").alias("b"))
        shared = F.least("s.hi", "b") - F.greatest("s.lo", "a")
        met = by_cell(live).withColumn("feature", F.col("s.feature")).join(over, ["feature", "cell"])
        refused = met.where((shared > 0) & (shared > reuse * (F.col("s.hi") - F.col("s.lo")))).select("rank").distinct()
        return cut(live.join(taken.select("owner"), "owner", "left_anti").join(refused, "rank", "left_anti"))

    live = cut(found.where(F.size("spans") > 0).withColumn("__cells", touched))
    if held is not None:
        live = left_by(live, held)
    kept = None
    while (left := live.count()) > finish:
        least = live.select("rank", F.size("__cells").alias("n"), F.explode("__cells").alias("c")).groupBy("c").agg(F.min(F.struct("rank", "n")).alias("m"))
        first = least.groupBy("m").agg(F.count("*").alias("k")).where(F.col("k") == F.col("m.n")).select("m.rank")
        taken = cut(live.join(live.groupBy("owner").agg(F.min("rank").alias("rank")).select("rank").join(first, "rank"), "rank", "left_semi"))
        kept = taken if kept is None else kept.unionByName(taken)
        live = left_by(live, taken)
    if left:
        # at most `finish` rows, in one order
        placed = live.withColumn("place", F.row_number().over(Window.orderBy("rank"))).withColumn("__all", F.lit(0)).select("__all", "place", "owner", "spans")
        hold = placed.groupBy("__all").applyInPandas(lambda pdf: greedy_spans(pdf.sort_values("place"), reuse)[["place"]], "place int")
        live = live.withColumn("place", F.row_number().over(Window.orderBy("rank"))).join(hold, "place", "left_semi").drop("place")
    return (live if kept is None else live.unionByName(kept)).drop("__cells")


def worst_rating(shares: DataFrame, least_m: float = 160.0) -> DataFrame:
    """shares(way, agency, record, share, length, level, ban) -> one record for each way and agency: a ban of the most
    covering record stands; else the highest level among records over `least_m` or half of the way (and the most
    covering one), of equal levels the most covering."""
    cover = F.struct((-F.col("share")).alias("s"), "record")
    first = shares.groupBy("way", "agency").agg(F.min(cover).alias("first"))
    both = shares.join(first, ["way", "agency"]).withColumn("is_first", cover == F.col("first"))
    long_ = (F.col("share") * F.col("length") >= least_m) | (F.col("share") >= 0.5)
    may = both.where(F.col("is_first") | (~F.col("ban") & long_))
    # a ban first, then the level, then the cover
    rank = F.struct((F.col("is_first") & F.col("ban")).cast("int").alias("b"), F.col("level").alias("l"), F.col("share").alias("s"), (-F.col("record")).alias("r"))
    return may.groupBy("way", "agency").agg(F.max(rank).alias("m")).select("way", "agency", (-F.col("m.r")).alias("record"), F.col("m.l").alias("level"))


def small_loops(ways: DataFrame, most: float) -> DataFrame:
    """ways(way long, name, a, b, length), a and b its end nodes -> ways that close into rings of one name: every end
    is used exactly twice, and the ring is at most `most` round."""
    ends = ways.select("way", "name", F.explode(F.array("a", "b")).alias("end"))
    first = ends.groupBy("name", "end").agg(F.min("way").alias("v"), F.count("*").alias("n"))
    met = ends.join(first, ["name", "end"])
    labels = components(met.select(F.col("way").alias("u"), "v")).toDF("way", "ring")
    of = ways.join(labels, "way", "left").withColumn("ring", F.coalesce("ring", "way"))
    closed = met.join(of.select("way", "ring"), "way").groupBy("ring").agg(F.bool_and(F.col("n") == 2).alias("closed"))
    size = of.groupBy("ring").agg(F.sum("length").alias("around"))
    return of.join(closed.where("closed").join(size.where(F.col("around") <= most), "ring"), "ring", "left_semi").select("way", "ring")


def through_networks(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """inner(way long, node long, reason string or null), outer(node) -> (network, ways, entries): connected inner ways that
    touch the outside at two nodes or more and hold a reason."""
    inner = dealt(inner, "way")
    first = inner.groupBy("node").agg(F.min("way").alias("v"))
    labels = cut(components(hub_join(inner.select("way", "node"), first, "node").where("v IS NOT NULL").select(F.col("way").alias("u"), "v")).toDF("way", "network"))
    # a way is in one network, and so is a node: that of any way at it
    network = F.coalesce("network", "way")
    ways = inner.groupBy("way").agg(F.bool_or(F.col("reason").isNotNull()).alias("reasoned")).join(labels, "way", "left").groupBy(network.alias("network")).agg(F.count("*").alias("ways"), F.bool_or("reasoned").alias("reasoned"))
    nodes = first.where("node IS NOT NULL").join(outer.select("node").distinct(), "node", "left_semi").select(F.col("v").alias("way"))
    entries = nodes.join(labels, "way", "left").groupBy(network.alias("network")).agg(F.count("*").alias("entries"))
    return ways.join(entries, "network").where("entries >= 2 and reasoned").select("network", "ways", "entries")


def tier_steps(base: Column, road: Column, count: Column, speed: Column, posted: Column, facility: Column, access: Column, rough: Column, expressway: Column, urban: Column, lanes: Column) -> Column:
    """Level of a road after the documented steps on top of its table tier: volume, class floors, restricted motor
    traffic, rough surface, avoid, busy roads. Null counts and speeds decide nothing. Half levels are halves."""
    tier = base.cast("double")
    bare, single = ~facility, lanes <= 1
    down = bare & single & (count <= 1500) & (~posted | (speed <= 35))
    tier = F.when(down, F.greatest(tier - 1, F.lit(1.0))).when(bare & single & (count >= 8000), F.least(tier + 1, F.lit(4.0))).when(bare & single & (count > 1500) & (speed <= 20) & (tier == 1), 2.0).otherwise(tier)
    floor = F.when(road.isin("trunk", "primary", "secondary"), 3.0).when(road == "tertiary", 2.0).otherwise(1.0)
    tier = F.when(bare, F.greatest(tier, floor)).otherwise(tier)
    cap = F.when(access.isin("no", "agricultural", "forestry"), 1.0).when(access.isin("private", "destination", "permit", "delivery"), 2.0)
    cap = cap + F.when(posted & (speed > 30), 1.0).otherwise(0.0)
    tier = F.when(cap.isNotNull() & count.isNull(), F.least(tier, cap)).otherwise(tier)
    tier = F.when(rough & (tier == 1), 2.0).otherwise(tier)
    fast = expressway & posted & (speed >= 50) & road.isin("trunk", "trunk_link", "primary", "primary_link")
    tier = F.when(urban & bare & (tier == 3) & (count >= 20000), 4.0).when(urban & bare & (tier == 3) & (count >= 12000), 3.5).when(~urban & bare & single & road.isin("primary", "trunk") & (tier == 4) & (count >= 18000), 4.5).otherwise(tier)
    return F.when(fast & urban, 5.0).when(fast, 4.5).otherwise(tier)
