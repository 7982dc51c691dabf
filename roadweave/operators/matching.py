"""Whole conflation of agency lines with ways: measured probe by probe, claimed stretch by stretch.

A way is read at probes an even spacing apart. A probe meets the segments of lines near it by cells (a segment lies in the
cells that its own length, a piece at a time, comes within reach of), and keeps the nearest segment of each line. From that
come three passes, each over what the one before left: single lines that cover a way, lines that cover it piece by
piece, and the other carriageway of a road whose count is taken. Blocks, which describe a road and aren't used up, are
shared out by the same probes. Coordinates are planar metres; lines with fewer than two points or a null one are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.operators.conflation import BEARING, OVERLAP, SEPARATION, exclusive
from roadweave.session import cut_spread as cut
from roadweave.session import spread

# Metres a heading is read over, probes that make a line one of a way's, a count that only a freeway
# carries where levels are stacked.
HEADING_SPAN, LEAST_PROBES, STACKED_COUNT = 8.0, 2, 20_000


def _metres(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def _course(a: Column, b: Column) -> Column:
    """Degrees from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])), F.lit(360.0))


def _turn(a: Column, b: Column) -> Column:
    """The angle between two headings, 0 to 180."""
    return F.abs(F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0)


def aligned(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two headings run along one line, either way."""
    return F.least(_turn(a, b), 180.0 - _turn(a, b)) <= tolerance


def _usable(lines: DataFrame) -> DataFrame:
    whole = F.forall("pts", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return lines.where((F.size("pts") >= 2) & whole)


def _ends_course() -> Column:
    """From a line's first point to its last; null for a ring."""
    a, b = F.element_at("pts", 1), F.element_at("pts", -1)
    return F.when((a["x"] != b["x"]) | (a["y"] != b["y"]), _course(a, b))


def way_probes(ways: DataFrame, spacing: float = SEPARATION, least: float = HEADING_SPAN) -> DataFrame:
    """ways(way, pts array of (x, y)) -> (way, course, probes, slot, x, y, heading): points along each way, `spacing` or a
    little more apart, segment ends among them, and the heading of the segment there. A segment shorter than `least`
    takes its heading from wider neighbours: points before and after it in turn, until they are so far apart."""
    pts = F.col("pts")
    at, last = (lambda i: F.get(pts, i)), F.size(pts) - 1

    def heading(i):  # of the segment from point i - 1 to i
        def wider(s, _):
            low, high = s["low"], s["high"]
            short = _metres(at(low), at(high)) < least
            low = F.when(short & (low > 0), low - 1).otherwise(low)
            high = F.when(short & (high < last) & (_metres(at(low), at(high)) < least), high + 1).otherwise(high)
            return F.struct(low.alias("low"), high.alias("high"))

        tries = F.when(_metres(at(i - 1), at(i)) < least, F.sequence(F.lit(1), F.size(pts))).otherwise(F.array().cast("array<int>"))
        span = F.aggregate(tries, F.struct((i - 1).cast("int").alias("low"), i.cast("int").alias("high")), wider)
        return _course(at(span["low"]), at(span["high"]))

    def along(i):
        a, b = at(i - 1), at(i)
        steps = F.greatest(F.lit(1), F.floor(_metres(a, b) / spacing).cast("int"))
        return F.transform(
            F.sequence(F.when(i == 1, 0).otherwise(1), steps),
            lambda s: F.struct((a["x"] + (b["x"] - a["x"]) * (s / steps)).alias("x"), (a["y"] + (b["y"] - a["y"]) * (s / steps)).alias("y"), i.alias("segment")),
        )

    turned = _usable(ways).withColumn("headings", F.transform(F.sequence(F.lit(1), F.size(pts) - 1), heading))
    spread = turned.select("way", _ends_course().alias("course"), "headings", F.flatten(F.transform(F.sequence(F.lit(1), F.size(pts) - 1), along)).alias("p"))
    each = spread.select("way", "course", "headings", F.size("p").alias("probes"), F.posexplode("p").alias("slot", "p"))
    return each.select("way", "course", "probes", "slot", "p.x", "p.y", F.element_at("headings", F.col("p.segment")).alias("heading"))


def line_segments(lines: DataFrame) -> DataFrame:
    """lines(feature, pts) -> (feature, fcourse, total, seq, ax, ay, bx, by, start, fheading): segments with a length, and
    the metres along the line at which each begins."""
    pts = F.col("pts")
    steps = F.transform(F.sequence(F.lit(1), F.size(pts) - 1), lambda i: _metres(F.get(pts, i - 1), F.get(pts, i)))
    # running sums, as one pass over the array
    starts = F.aggregate(F.col("steps"), F.array(F.lit(0.0)), lambda s, m: F.concat(s, F.array(F.element_at(s, -1) + m)))
    of = _usable(lines).select("feature", "pts", _ends_course().alias("fcourse"), steps.alias("steps")).withColumn("starts", starts)
    each = of.select("feature", "pts", "fcourse", "starts", F.element_at("starts", -1).alias("total"), F.posexplode("steps").alias("seq", "m")).where("m > 0")
    a, b = F.get(pts, F.col("seq")), F.get(pts, F.col("seq") + 1)
    return each.select("feature", "fcourse", "total", "seq", a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.get("starts", F.col("seq")).alias("start"), _course(a, b).alias("fheading"))


def in_cells(segments: DataFrame, reach: float, size: float) -> DataFrame:
    """Segments, a row for each cell of side `size` that a piece of them, at most as long as a cell, comes within reach of."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    pieces = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / size).cast("int"))
    slack = reach * (1 + 1e-9) + 1e-6

    def covered(k):
        (x0, y0), (x1, y1) = [(F.col("ax") + dx * (s / pieces), F.col("ay") + dy * (s / pieces)) for s in (k, k + 1)]
        cells = lambda a, b: F.sequence(F.floor((F.least(a, b) - slack) / size), F.floor((F.greatest(a, b) + slack) / size))
        return F.flatten(F.transform(cells(x0, x1), lambda i: F.transform(cells(y0, y1), lambda j: F.struct(i.alias("cx"), j.alias("cy")))))

    return segments.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), pieces - 1), covered)))))


def near_lines(probes: DataFrame, segments: DataFrame, reach: float = SEPARATION, gate: Column | None = None) -> DataFrame:
    """Each probe with each line within reach: (way, slot, probes, heading, feature, total, distance, along, fheading), the
    last three of the line's nearest segment (of equal ones the first). gate: a condition on the pair, of columns of
    both sides. A row of the result is a probe and a line near it."""
    size = 4 * reach
    cell = F.struct(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    pairs = spread(probes.withColumn("cell", cell)).join(in_cells(segments, reach, size), "cell")
    if gate is not None:
        pairs = pairs.where(gate)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)))
    px, py = F.col("ax") + dx * t - F.col("x"), F.col("ay") + dy * t - F.col("y")
    met = pairs.withColumns({"d2": px * px + py * py, "along": F.col("start") + F.sqrt(dx * dx + dy * dy) * t}).where(F.col("d2") <= reach * reach)
    best = met.groupBy("way", "slot", "feature").agg(F.min(F.struct("d2", "seq", "along", "fheading")).alias("b"), *[F.first(c).alias(c) for c in ("probes", "heading", "total")])
    return best.select("way", "slot", "probes", "heading", "feature", "total", F.sqrt("b.d2").alias("distance"), "b.along", "b.fheading")


def covering_lines(probes: DataFrame, segments: DataFrame, reach: float = SEPARATION, overlap: float = OVERLAP, bearing: float = BEARING) -> DataFrame:
    """(way, feature, share, ranked, apart, lo, hi): lines that run end to end as the way does and are within reach of a
    share of its probes. ranked leaves out the probes where the way runs on past an end of the line; lo and hi are the
    metres of the line that the way lies along."""
    near = near_lines(probes, segments, reach, aligned(F.col("course"), F.col("fcourse"), bearing))
    edge = lambda f: f(F.struct("slot", "along"))
    sums = near.groupBy("way", "feature").agg(F.count("*").alias("n"), F.first("probes").alias("probes"), F.first("total").alias("total"), F.min("along").alias("lo"), F.max("along").alias("hi"), F.avg("distance").alias("apart"), edge(F.min).alias("a"), edge(F.max).alias("z"))
    at_end = lambda c: (F.col(f"{c}.along") <= reach) | (F.col(f"{c}.along") >= F.col("total") - reach)
    past = F.when(at_end("a"), F.col("a.slot")).otherwise(0) + F.when(at_end("z"), F.col("probes") - 1 - F.col("z.slot")).otherwise(0)
    found = sums.select("way", "feature", (F.col("n") / F.col("probes")).alias("share"), (F.col("n") / (F.col("probes") - past)).alias("ranked"), "apart", "lo", "hi")
    return found.where(F.col("share") >= overlap)


def route_numbers(ref: Column) -> Column:
    """The route numbers of a list with semicolons, without marks and spaces, in capitals."""
    parts = F.transform(F.split(F.upper(F.coalesce(ref, F.lit(""))), ";"), lambda p: F.regexp_replace(p, "[^A-Z0-9]", ""))
    return F.array_remove(parts, "")


def same_road(agree: Column, ref: Column, fref: Column) -> Column:
    """Whether a line may be a way's by what they are called. agree: whether their names do, null if one has none."""
    return F.coalesce(agree, F.lit(True)) | F.arrays_overlap(route_numbers(ref), route_numbers(fref))


def _filled(df: DataFrame, **kinds: str) -> DataFrame:
    """df with a null column of the kind for each that it lacks; null booleans and whole numbers are false and 0."""
    for name, kind in kinds.items():
        df = df.withColumn(name, (F.col(name) if name in df.columns else F.lit(None)).cast(kind))
        if kind in ("boolean", "int", "long"):
            df = df.withColumn(name, F.coalesce(name, F.lit(0).cast(kind)))
    return df


def lying_along(probes: DataFrame, segments: DataFrame, pairs: DataFrame | None, reach: float, bearing: float, least: int) -> DataFrame:
    """(way, feature, n, probes, with_line, lo, hi, summed): for each way the lines that are the best of `least` of its
    probes or more, headings agreeing where they are. Best is the least (rank, distance, feature); pairs(way,
    feature, rank) says which may meet (null: all, of one rank). with_line: probes that head as the line is drawn."""
    near = near_lines(probes, segments, reach).where(aligned(F.col("heading"), F.col("fheading"), bearing))
    near = near.withColumn("rank", F.lit(0)) if pairs is None else near.join(pairs.select("way", "feature", "rank"), ["way", "feature"])
    ahead = (_turn(F.col("heading"), F.col("fheading")) <= 90).cast("int").alias("ahead")
    won = near.groupBy("way", "slot").agg(F.min(F.struct("rank", "distance", "feature", ahead, "along")).alias("b"), F.first("probes").alias("probes"))
    sums = won.groupBy("way", "b.feature").agg(F.count("*").alias("n"), F.first("probes").alias("probes"), F.sum("b.ahead").alias("with_line"), F.min("b.along").alias("lo"), F.max("b.along").alias("hi"), F.sum("b.distance").alias("summed"))
    return sums.where(F.col("n") >= F.least(F.lit(least), F.col("probes")))


def pieced_lines(lying: DataFrame, features: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """lying_along's rows, features(feature, precedence, count) -> (way, feature, precedence, share, apart, spans): ways that
    their lines cover together, with the line whose count is the median along the way (among the lines of best
    precedence, weighted by probes, the lower of two), and all stretches that the way then takes."""
    each = F.struct("precedence", "count", "feature", "n", "lo", "hi")
    ways = lying.join(features.select("feature", "precedence", "count"), "feature").groupBy("way").agg(F.array_sort(F.collect_list(each)).alias("all"), F.sum("n").alias("n"), F.first("probes").alias("probes"), F.sum("summed").alias("summed"))
    ways = ways.where(F.col("n") >= overlap * F.col("probes")).withColumn("best", F.filter("all", lambda r: r["precedence"] == F.get("all", 0)["precedence"]))
    half = F.aggregate("best", F.lit(0).cast("long"), lambda s, r: s + r["n"])

    def step(s, r):
        run = s["run"] + r["n"]
        return F.struct(run.alias("run"), F.coalesce(s["feature"], F.when(2 * run >= half, r["feature"])).alias("feature"))

    kind = dict(features.dtypes)["feature"]
    middle = F.aggregate("best", F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast(kind).alias("feature")), step)
    spans = F.transform("all", lambda r: F.struct(r["feature"].alias("feature"), r["lo"].alias("lo"), r["hi"].alias("hi")))
    return ways.select("way", middle["feature"].alias("feature"), F.get("all", 0)["precedence"].alias("precedence"), F.least(F.lit(1.0), F.col("n") / F.col("probes")).alias("share"), (F.col("summed") / F.col("n")).alias("apart"), spans.alias("spans"))


def carriageway_shares(matched: DataFrame, rejected: DataFrame, ways: DataFrame) -> DataFrame:
    """matched(way, feature), rejected(way, feature, place), ways(way, divided, street) -> (way, feature): of a divided
    road's carriageways the one that was refused a line, has none of its own, and whose street is that of a
    carriageway that holds the line; of several lines the first by place."""
    sides = ways.where("divided and street IS NOT NULL").select("way", "street")
    holding = matched.join(sides, "way").select("feature", "street").distinct()
    open_ = rejected.join(matched.select("way"), "way", "left_anti").join(sides, "way")
    return open_.join(holding, ["feature", "street"], "left_semi").groupBy("way").agg(F.min(F.struct("place", "feature")).alias("m")).select("way", "m.feature")


def conflate(ways: DataFrame, features: DataFrame, agree: Column | None = None, reach: float = SEPARATION, overlap: float = OVERLAP, bearing: float = BEARING) -> tuple[DataFrame, DataFrame]:
    """Counts of agency lines for ways: (matched(way, feature, share, step), refused(way, feature, place)).

    ways(way long, pts; name, ref, street, trail, nameless, freeway, divided, layer int where known), features(feature
    long, pts, precedence int, count long; fname, fref where known). agree: whether the names of a pair do, of columns
    name and fname. Trails and ways that must have a name agreeing take no count. step 1: one line covers the way; best by
    precedence, share inside the line's ends, nearness, ids; a way takes one line, and of a line's stretch at most
    a quarter twice. A line whose nearest way is a freeway, or that carries STACKED_COUNT under or over one, goes to
    freeways; step 2 gives it back to streets if none took it and a street is nearest. step 3: ways with no such
    line take the lines they run along piece by piece, all stretches or none. step 4: other carriageways.
    """
    ways, features = spread(ways), spread(features)
    ways = _filled(ways, name="string", ref="string", street="string", trail="boolean", nameless="boolean", freeway="boolean", divided="boolean", layer="int")
    features = _filled(features, fname="string", fref="string", count="long")
    traits = ways.select("way", "name", "ref", "freeway", "layer")
    called = features.select("feature", "precedence", "count", "fname", "fref")
    same = same_road(F.lit(None).cast("boolean") if agree is None else agree, F.col("ref"), F.col("fref"))
    probes = way_probes(ways.where("NOT trail AND NOT nameless"))
    segments = cut(line_segments(features))
    found = cut(covering_lines(probes, segments, reach, overlap, bearing).join(traits, "way").join(called, "feature").where(same))
    levels = F.collect_set
    lines = found.groupBy("feature").agg(
        F.min(F.struct("apart", ~F.col("freeway"))).alias("m"),
        F.array_sort(levels(F.when((F.col("count") >= STACKED_COUNT) & F.col("freeway"), F.col("layer")))).alias("above"),
        F.array_sort(levels(F.when((F.col("count") >= STACKED_COUNT) & ~F.col("freeway"), F.col("layer")))).alias("below"),
    ).select("feature", F.col("m.col2").alias("street_nearest"), ((F.size("above") > 0) & (F.size("below") > 0) & (F.col("above") != F.col("below"))).alias("stacked"))
    lines = cut(lines.select("feature", "street_nearest", (~F.col("street_nearest") | F.col("stacked")).alias("for_freeways")))
    rank = F.struct("precedence", (-F.col("ranked")).alias("r"), "apart", "way", "feature")
    spans = F.array(F.struct("feature", "lo", "hi"))
    placed = cut(found.join(lines, "feature").select(F.col("way").alias("owner"), rank.alias("rank"), spans.alias("spans"), "share", "freeway", "street_nearest", (F.col("for_freeways") & ~F.col("freeway")).alias("held")))
    first = exclusive(placed.where("NOT held"))
    used = first.select("rank.feature").distinct()
    back = exclusive(placed.where("held AND street_nearest").join(used, F.col("rank.feature") == used["feature"], "left_anti"), held=first)
    # lines that stay off the streets beside them
    theirs = first.where("freeway").select("rank.feature").distinct().join(lines.where("for_freeways"), "feature", "left_semi").unionByName(lines.where("for_freeways AND NOT street_nearest").select("feature")).distinct()
    rest = probes.join(found.select("way").distinct(), "way", "left_anti")
    may = near_pairs(rest, segments, reach).join(traits, "way").join(called, "feature").where(same).join(theirs.withColumn("theirs", F.lit(True)), "feature", "left").where("freeway OR theirs IS NULL").select("way", "feature", F.lit(0).alias("rank"))
    along = pieced_lines(lying_along(rest, segments, may, reach, bearing, LEAST_PROBES), called, overlap)
    along = cut(along.select(F.col("way").alias("owner"), F.struct("precedence", (-F.col("share")).alias("r"), "apart", "way", "feature").alias("rank"), "spans", "share"))
    third = exclusive(along, held=first.select("owner", "spans").unionByName(back.select("owner", "spans")))
    told = lambda df, step: df.select(F.col("owner").alias("way"), "rank.feature", "share", F.lit(step).alias("step"))
    matched = cut(told(first, 1).unionByName(told(back, 2)).unionByName(told(third, 3)))
    tried = placed.where("NOT held").select("rank", "share", F.lit(1).alias("turn")).unionByName(placed.where("held AND street_nearest").join(used, F.col("rank.feature") == used["feature"], "left_anti").select("rank", "share", F.lit(2).alias("turn"))).unionByName(along.select("rank", "share", F.lit(3).alias("turn")))
    refused = cut(tried.select("rank.way", "rank.feature", "share", F.struct("turn", "rank").alias("place")).join(matched.select("way", "feature"), ["way", "feature"], "left_anti"))
    other = carriageway_shares(matched, refused, ways)
    shared = other.join(refused.groupBy("way", "feature").agg(F.max("share").alias("share")), ["way", "feature"]).select("way", "feature", "share", F.lit(4).alias("step"))
    return matched.unionByName(shared), refused


def near_pairs(probes: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """(way, feature) of lines with a segment in the cells of a way's probes."""
    size = 4 * reach
    cell = F.struct(F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
    return spread(probes.select("way", cell.alias("cell")).distinct()).join(in_cells(segments, reach, size).select("feature", "cell").distinct(), "cell").select("way", "feature").distinct()


def block_shares(ways: DataFrame, blocks: DataFrame, agree: Column, reach: float = SEPARATION, bearing: float = BEARING, least: int = LEAST_PROBES, coverage: float = OVERLAP) -> DataFrame:
    """Blocks that ways lie along: (way, feature, share, agrees, with_line). ways(way, pts, name; trail, required, free where
    known), blocks(feature, pts, fname; freeway_block where known); agree as in `conflate`.

    At each probe the way runs along one block: a block whose name agrees before one of which it isn't known, before one
    that disagrees, then the nearest. A required way takes blocks that agree only; one that disagrees is taken by
    free ways from freeway blocks only, and dropped where another block of the way agrees. Blocks of `least` probes
    count, and where they cover `coverage` of the way together it is matched. Blocks aren't used up."""
    ways = _filled(spread(ways), trail="boolean", required="boolean", free="boolean")
    blocks = _filled(spread(blocks), freeway_block="boolean")
    probes = way_probes(ways.where("NOT trail"), reach)
    segments = cut(line_segments(blocks))
    named = near_pairs(probes, segments, reach).join(ways.select("way", "name", "required", "free"), "way").join(blocks.select("feature", "fname", "freeway_block"), "feature").withColumn("agrees", agree)
    no = F.coalesce(~F.col("agrees"), F.lit(False))
    may = named.where((~F.col("required") | F.coalesce("agrees", F.lit(False))) & (~no | (F.col("free") & F.col("freeway_block"))))
    may = cut(may.select("way", "feature", "agrees", F.when(F.col("agrees").isNull(), 1).when(F.col("agrees"), 0).otherwise(2).alias("rank")))
    lying = lying_along(probes, segments, may, reach, bearing, least).join(may.select("way", "feature", "agrees"), ["way", "feature"])
    shares = lying.select("way", "feature", (F.col("n") / F.col("probes")).alias("share"), "agrees", (2 * F.col("with_line") >= F.col("n")).alias("with_line"), "n", "probes")
    sure = F.coalesce(F.col("agrees"), F.lit(False))
    of_way = shares.groupBy("way").agg(F.bool_or(sure).alias("known"), F.sum("n").alias("all"), F.sum(F.when(F.coalesce("agrees", F.lit(True)), F.col("n"))).alias("kept"))
    covered = F.when(F.col("known"), F.col("kept")).otherwise(F.col("all"))
    held = shares.join(of_way, "way").where(~F.col("known") | F.coalesce("agrees", F.lit(True))).where(covered >= coverage * F.col("probes"))
    return held.select("way", "feature", "share", "agrees", "with_line")


def unmatched_blocks(shares: DataFrame, ways: DataFrame, blocks: DataFrame, reach: float = SEPARATION, bearing: float = BEARING, coverage: float = OVERLAP) -> DataFrame:
    """(feature): blocks that no way lies along and that don't run along a matched way for `coverage` of their own length."""
    left = spread(blocks).join(shares.select("feature").distinct(), "feature", "left_anti").select("feature", "pts")
    lines = spread(ways).join(shares.select("way").distinct(), "way", "left_semi").select(F.col("way").alias("feature"), "pts")
    probes = way_probes(left.select(F.col("feature").alias("way"), "pts"), max(reach / 4, 1.0))
    near = near_lines(probes, line_segments(lines), reach).where(aligned(F.col("heading"), F.col("fheading"), bearing))
    covered = near.groupBy("way").agg(F.countDistinct("slot").alias("n"), F.first("probes").alias("probes")).where(F.col("n") >= coverage * F.col("probes"))
    return left.select("feature").join(covered.select(F.col("way").alias("feature")), "feature", "left_anti")
