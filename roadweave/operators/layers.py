"""Layers and reports over road segments: which rows a map level draws, runs of same-named lines, sums that check a build.

segments: way, name, tier, facility, trail (boolean), unpaved, route (0-3), bridge (0-2), run_m, calm_run_m,
car_free (array), length. Predicates look only at the columns that a table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.graph import components
from roadweave.operators.joins import interval_overlap_join, proximity_join
from roadweave.session import cut

MILE = 1609.344
# Bars of the zoomed-out levels, in miles (paved run, unpaved run) and route levels; runs of the ride layer; busy roads.
LONG_TRAILS = {11: (2.5, 5.0, 3), 10: (5.0, 8.0, 3)}
PAVED_ROUTE, BUSY_TIER, CALM_TIER = 2, 3, 2


def has(df: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(df.columns)


def timed_closure(df: DataFrame) -> Column:
    """Closed to cars at set times, where the table says so."""
    return F.coalesce(F.size("car_free") > 0, F.lit(False)) if has(df, "car_free") else F.lit(False)


def trails(df: DataFrame) -> Column:
    """Paths, and protected ways that are trails of their own; without a facility column the trail class alone."""
    return (F.col("facility") == "path") | ((F.col("facility") == "protected") & F.col("trail")) if has(df, "facility") else F.col("trail")


def long_trails(df: DataFrame, level: int) -> Column:
    """On a route of a high enough level for its surface, or in a run of same-named trails that is long enough. A bridge
    has the surface of its trail."""
    paved, rough, route = LONG_TRAILS[level]
    unpaved = F.when(F.col("bridge") == 1, False).when(F.col("bridge") == 2, True).otherwise(F.coalesce("unpaved", F.lit(False)))
    run = F.coalesce("run_m", F.lit(0))
    long_ = F.when(unpaved, (F.col("route") >= route) | (run >= round(rough * MILE))).otherwise((F.col("route") >= PAVED_ROUTE) | (run >= round(paved * MILE)))
    return long_ | timed_closure(df)


def ride_layer(df: DataFrame, path_m: float, road_m: float) -> Column:
    """Trails in long enough calm runs, calm roads in longer ones, and timed closures."""
    run = F.coalesce("calm_run_m", F.lit(0))
    return (trails(df) & (run >= path_m)) | ((F.col("tier") <= CALM_TIER) & ~F.col("trail") & (run >= road_m)) | timed_closure(df)


def busy(df: DataFrame) -> Column:
    return trails(df) | timed_closure(df) | (F.col("tier") >= BUSY_TIER)


def drawn(df: DataFrame, level: int, optional=("facility", "unpaved", "route")) -> DataFrame:
    """The rows and columns that a tile of this level reads: z10 and z11 long trails, z12 and z13 the ride layer with busy
    roads, beyond all; optional columns that the table lacks are left out."""
    chosen = trails(df) & long_trails(df, level) if level in LONG_TRAILS else ride_layer(df, MILE, MILE / 2) | busy(df) if level < 14 else F.lit(True)
    return df.where(chosen).select("way", "name", "tier", *[c for c in optional if has(df, c)])


def chains(lines: DataFrame, gap: float) -> DataFrame:
    """lines(id long, name, x, y, length) -> (id, chain, run): lines of one name within gap of one another, and on through
    others, are one chain, named by its smallest id; run is its length. Lines without a name are in none."""
    named = lines.where(F.col("name").isNotNull())
    # several lines of one name at one place go with the first of them, spots with the first of their cell; only cells are linked
    spot = cut(named.groupBy("name", "x", "y").agg(F.min("id").alias("first")))
    own, links = cell_links(spot.select("name", F.col("first").alias("id"), "x", "y"), gap)
    found = cut(components(links)).withColumnRenamed("node", "first")
    led = own.select("name", "x", "y", "first").join(found, "first", "left").select("name", "x", "y", F.coalesce("component", "first").alias("chain"))
    of = named.join(led, ["name", "x", "y"], "left").withColumn("chain", F.coalesce("chain", "id"))
    sums = of.groupBy("chain").agg(F.sum("length").alias("run"))
    return of.select("id", "chain").join(sums, "chain").select("id", "chain", "run")


def near_links(spots: DataFrame, gap: float) -> DataFrame:
    """spots(name, id, x, y) -> (u, v): links by which the same spots hang together as by all pairs of a name within gap.

    Cells are so small that all spots of one are within gap, so each is linked to the cell's first."""
    own, between = cell_links(spots, gap)
    return own.where("id != first").select(F.col("id").alias("u"), F.col("first").alias("v")).unionByName(between)


def cell_links(spots: DataFrame, gap: float) -> tuple[DataFrame, DataFrame]:
    """Spots with their cell and the first spot in it, and (u, v): links between cells, given by their first spots. Of two
    cells the spots furthest towards each other are tried; only cells that no such link joins, over others too, are compared
    spot by spot."""
    size = gap / 2**0.5 * (1 - 1e-9)
    placed = spots.where("x IS NOT NULL AND y IS NOT NULL").withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    towards = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    spot = F.struct("id", "x", "y")
    ends = [f(spot, F.col("x") * i + F.col("y") * j).alias(f"{side}{k}") for k, (i, j) in enumerate(towards) for side, f in (("to", F.max_by), ("from", F.min_by))]
    cells = cut(placed.groupBy("name", "cx", "cy").agg(F.min("id").alias("first"), *ends))
    own = placed.join(cells.select("name", "cx", "cy", "first"), ["name", "cx", "cy"])
    there = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.col(f"to{k}").alias("a")) for k, (i, j) in enumerate(towards)])
    asked = cells.select("name", F.col("first").alias("u"), F.explode(there).alias("t")).select("name", "u", "t.*")
    offered = cells.select("name", "cx", "cy", F.col("first").alias("v"), F.array(*[F.col(f"from{k}") for k in range(len(towards))]).alias("b"))
    beside = cut(asked.join(offered, ["name", "cx", "cy"]).withColumn("b", F.get("b", F.col("k"))).select("name", "u", "v", "a", "b"))
    within = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]) <= gap * gap
    sure = beside.where(within(F.col("a"), F.col("b"))).select("u", "v")
    of = cut(components(sure))
    left = beside.join(of.toDF("u", "gu"), "u", "left").join(of.toDF("v", "gv"), "v", "left").where(~F.coalesce(F.col("gu") == F.col("gv"), F.lit(False))).select("u", "v")
    each = own.select(F.col("first").alias("cell"), spot.alias("s"))
    open_ = left.join(each.select(F.col("cell").alias("u"), F.col("s").alias("a")), "u").join(each.select(F.col("cell").alias("v"), F.col("s").alias("b")), "v").where(within(F.col("a"), F.col("b")))
    return own, sure.unionByName(open_.select("u", "v").distinct())


def by_level(segments: DataFrame, level: str) -> DataFrame:
    """Per level: distinct ways, length, and the length of what a map may draw."""
    shown = F.sum(F.when(F.col("tier") < 5, F.col("length")))
    return segments.where(F.col(level).isNotNull()).groupBy(level).agg(F.countDistinct("way").alias("ways"), F.sum("length").alias("length"), F.coalesce(shown, F.lit(0)).alias("shown"), F.countDistinct(F.when(F.col("name").isNotNull(), F.col("way"))).alias("named"))


def watched(segments: DataFrame, ways: DataFrame) -> DataFrame:
    """Highest route and longest runs of the ways that a build is checked by; a way that isn't there is absent."""
    return segments.join(ways, "way", "left_semi").groupBy("way").agg(F.max("route").alias("route"), F.coalesce(F.max("run_m"), F.lit(0)).alias("run_m"), F.coalesce(F.max("calm_run_m"), F.lit(0)).alias("calm_run_m"))


def trail_rows(segments: DataFrame) -> DataFrame:
    """Per named trail: length, share unpaved, ways; null share where it has no length."""
    whole = F.sum("length")
    rough = F.sum(F.when(F.col("unpaved"), F.col("length")).otherwise(0))
    return segments.where(F.col("name").isNotNull()).groupBy("name").agg(whole.alias("length"), F.when(whole != 0, rough / whole).alias("unpaved_share"), F.countDistinct("way").alias("ways"))


def medians(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, measure, median) of each column, in one pass: nulls are left out, and medians of 0."""
    stacked = rows.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select(by, "m.*")
    found = stacked.where(F.col("value").isNotNull()).groupBy(by, "measure").agg(F.percentile("value", 0.5).alias("median"))
    return found.where("median != 0")


def all_end(lines: DataFrame, spots: DataFrame, touch: float) -> DataFrame:
    """lines(line, at, x, y: vertices; first, last: of the line), spots(spot, sx, sy) -> (spot, all_end): whether every line
    with a vertex at a spot begins or ends there."""
    # a vertex brings its line's ends along, so a pair of spot and vertex is judged alone and no pair is shuffled
    ends = F.collect_list(F.when((F.col("at") == F.col("first")) | (F.col("at") == F.col("last")), F.struct("x", "y"))).over(Window.partitionBy("line"))
    vertices = lines.select("line", "at", "x", "y", "first", "last").withColumn("ends", ends).select("x", "y", "ends")
    near = lambda e: (F.col("sx") - e["x"]) * (F.col("sx") - e["x"]) + (F.col("sy") - e["y"]) * (F.col("sy") - e["y"]) <= touch * touch
    met = proximity_join(spots, vertices, ("sx", "sy"), ("x", "y"), touch)
    return met.groupBy("spot").agg(F.bool_and(F.exists("ends", lambda e: F.coalesce(near(e), F.lit(False)))).alias("all_end"))


def dense_numbers(df: DataFrame, keys: list[str], out: str = "number") -> DataFrame:
    """(keys..., number): dense ranks of the distinct keys in order, from 1, without any task seeing them all: keys are
    range-partitioned, numbered inside each part, and moved on by the parts before."""
    each = df.select(*keys).distinct().repartitionByRange(*keys)
    each = cut(each.withColumn("__part", F.spark_partition_id()))
    sizes = each.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each part
    ahead = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return each.withColumn("__own", own).join(F.broadcast(ahead), "__part").select(*keys, (F.col("__ahead") + F.col("__own")).alias(out))


def best_overlap(segments: DataFrame, lines: DataFrame, share: float) -> DataFrame:
    """segments(segment, road, a, b), lines(line, road, c, d) on roads' own measures -> (segment, line, covered): the line that
    covers most of a segment, at least share of it; ties: the smallest line."""
    mean = lines.agg(F.avg(F.col("d") - F.col("c"))).first()[0]
    met = interval_overlap_join(segments, lines, ["road"], ("a", "b"), ("c", "d"), mean if mean and mean > 0 else 1.0)
    met = met.withColumn("covered", F.least("b", "d") - F.greatest("a", "c"))
    best = met.where(F.col("covered") >= share * (F.col("b") - F.col("a"))).groupBy("segment").agg(F.max(F.struct("covered", (-F.col("line")).alias("m"))).alias("best"))
    return best.select("segment", (-F.col("best.m")).alias("line"), "best.covered")


def proposals(corridors: DataFrame, by: str, order: list) -> DataFrame:
    """corridors(by, id, t_in, t_out, ...) in order of worth -> (by, kind, ids): the best with the best that doesn't overlap
    it, in the order ridden; the best alone; the best that overlaps it."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = corridors.withColumn("__rank", F.row_number().over(w))
    first = F.first(F.struct("id", "t_in", "t_out")).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = ranked.withColumn("__first", first)
    over = (F.col("t_in") < F.col("__first.t_out")) & (F.col("__first.t_in") < F.col("t_out"))
    rest = F.col("__rank") > 1
    pick = lambda c: F.min(F.when(rest & c, F.struct("__rank", "id", "t_in")))
    found = placed.groupBy(by).agg(F.min("__first").alias("f"), pick(~over).alias("apart"), pick(over).alias("other"))
    pair = F.when(F.col("apart.t_in") < F.col("f.t_in"), F.array("apart.id", "f.id")).otherwise(F.array("f.id", "apart.id"))
    sets = F.array(
        F.struct(F.lit("both").alias("kind"), F.when(F.col("apart").isNotNull(), pair).alias("ids")),
        F.struct(F.lit("best").alias("kind"), F.array("f.id").alias("ids")),
        F.struct(F.lit("other").alias("kind"), F.when(F.col("other").isNotNull(), F.array("other.id")).alias("ids")),
    )
    return found.select(by, F.explode(sets).alias("s")).select(by, "s.kind", F.array_join(F.col("s.ids").cast("array<string>"), ",").alias("ids")).where("ids is not null")


def names_at(vertices: DataFrame) -> DataFrame:
    """vertices(node, line, name) -> (node, names): the different names of the lines that meet at a node, in order."""
    named = vertices.where(F.col("name").isNotNull()).groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"), F.countDistinct("line").alias("lines"))
    return named.where("lines > 1")


def opposite_carriageways(lines: DataFrame, distance: float, degrees: float) -> DataFrame:
    """lines(line, name, x, y, bearing) of one-way roads -> (a, b) of one name that run within distance of one another the
    other way round, give or take degrees."""
    other = lines.select(F.col("line").alias("b"), "name", F.col("x").alias("__x"), F.col("y").alias("__y"), F.col("bearing").alias("__b"))
    turn = F.abs(F.pmod(F.col("bearing") - F.col("__b") + 180, F.lit(360)) - 180)
    pairs = proximity_join(lines, other, ("x", "y"), ("__x", "__y"), distance, keep=(F.col("line") < F.col("b")) & (turn >= 180 - degrees), on=("name",))
    return pairs.select(F.col("line").alias("a"), "b")


def due(sources: DataFrame, now: Column) -> DataFrame:
    """sources(source, every_s, read_at) whose next read has come; one that was never read is due."""
    return sources.where(F.col("read_at").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("read_at") >= F.col("every_s"))).select("source")


def soonest(weekday: Column, minute: Column, now: Column) -> Column:
    """The next time, from now on, that it is this minute of this weekday (0 Monday)."""
    days = F.pmod(weekday - F.weekday(now), F.lit(7))
    today = F.date_trunc("day", now)
    at = lambda d: F.timestamp_add("MINUTE", (d * 1440 + minute).cast("long"), today)
    return F.when(at(days) < now, at(days + 7)).otherwise(at(days))


def start_docks(docks: DataFrame, by: str, count: int) -> DataFrame:
    """docks(by, dock, name, walk_s, extra_s, distance, usable) -> the best `count` to start from: by walk and extra riding
    (never below nothing), then distance, then name."""
    cost = F.col("walk_s") + F.greatest(F.col("extra_s"), F.lit(0))
    w = Window.partitionBy(by).orderBy("cost", "distance", "name", "dock")
    return docks.where("usable").withColumn("cost", cost).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count).select(by, "dock", "cost", "rank")


def one_per_place(answers: DataFrame, query: str, place: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """answers(query, score, id, name, x, y, ...) inside the box with a name: the best row of each place, ranked by score."""
    inside = answers.where(F.col("name").isNotNull() & F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    w = Window.partitionBy(query, *place).orderBy(F.desc("score"), "id")
    best = inside.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), "id")))


def held_lengths(rows: DataFrame, by: list[str], length: str, **holds: Column) -> DataFrame:
    """Of each group the whole length, and the length for which each named condition holds (null doesn't)."""
    n = F.coalesce(F.col(length), F.lit(0))
    sums = [F.sum(F.when(condition, n).otherwise(0)).alias(name) for name, condition in holds.items()]
    return rows.groupBy(*by).agg(F.sum(n).alias("total"), *sums)


def level_share(rows: DataFrame, expected: DataFrame, by: str, share: float, least: float) -> DataFrame:
    """rows(by, level, length), expected(by, want, at_least) -> of each expected group its length, the length at the
    wanted level (or above, where at_least), and whether it reads: unread below `least` of length, else ok or off."""
    met = F.when(F.col("at_least"), F.col("level") >= F.col("want")).otherwise(F.col("level") == F.col("want"))
    # levels are few: what is joined is a row for each group and level
    few = rows.groupBy(by, "level").agg(F.sum("length").alias("length"))
    found = held_lengths(expected.join(few, by, "left"), [by, "want", "at_least"], "length", held=met)
    state = F.when(F.col("total") < least, "unread").when(F.col("held") >= share * F.col("total"), "ok").otherwise("off")
    return found.withColumn("state", state)


def counted_lengths(rows: DataFrame, by: list[str], length: str) -> DataFrame:
    """Rows and their length by class."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(length).alias("length"))
