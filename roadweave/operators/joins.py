"""Joins that plain equality doesn't express, as equi-joins on buckets with an exact filter after."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.geo import EARTH, haversine, point
from roadweave.session import cut, shares, spread

PAIRS = 40_000_000  # pairs that a task of a proximity join compares, some seconds' work
PIECE = 10_000_000  # pairs of a cell that stay together, so that a task gets several keys and tasks are of like size


def with_cells(df: DataFrame, x: str, y: str, size: float, around: bool = False) -> DataFrame:
    """Adds cell: the square of side `size` that holds (x, y), or it and the eight around it, a row each."""
    cx, cy = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not around:
        return df.withColumn("cell", F.struct(cx.alias("cx"), cy.alias("cy")))
    near = [F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return df.withColumn("cell", F.explode(F.array(*near)))


def proximity_join(left: DataFrame, right: DataFrame, lxy, rxy, radius: float, keep: Column | None = None, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within `radius` (planar, inclusive), with squared distance d2. The larger side isn't
    multiplied: give it as `right`. Rows without coordinates join nothing. on: columns of both sides that must be
    equal too; they are join keys, so that a busy cell is split by them. Both sides are dealt by cell, none is broadcast,
    to as many tasks as there are rows and pairs to compare; the rows of right in a cell with very many pairs are dealt to several."""
    (lx, ly), (rx, ry) = lxy, rxy
    here = lambda df, *columns: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*columns, *on)]))
    keys, near, far = ["cell", *on], with_cells(here(left, lx, ly), lx, ly, radius, around=True), with_cells(here(right, rx, ry), rx, ry, radius)
    met = near.select(*keys, F.lit(1).alias("m"), F.lit(0).alias("n")).unionByName(far.select(*keys, F.lit(0).alias("m"), F.lit(1).alias("n"))).groupBy(*keys).agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    met = met.withColumn("pieces", F.least("n", F.ceil(F.col("m") * F.col("n") / PIECE)))
    rows, near_rows, pairs, most = met.agg(F.sum("n"), F.sum("m"), F.sum(F.col("m").cast("double") * F.col("n")), F.max("pieces")).first()
    if most and most > 1:
        # a row for so many pairs, so few
        busy = met.where("pieces > 1").select(*keys, "pieces")
        busy = F.broadcast(left.sparkSession.createDataFrame(busy.collect(), busy.schema))
        pieces = F.coalesce("pieces", F.lit(1))
        near = near.join(busy, keys, "left").withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("pieces")
        far = far.withColumn("__row", F.monotonically_increasing_id()).join(busy, keys, "left").withColumn("__piece", F.pmod("__row", pieces)).drop("__row", "pieces")
        keys = [*keys, "__piece"]
    tasks = max(shares(left.sparkSession, max(rows or 0, near_rows or 0)), math.ceil((pairs or 0) / PAIRS))
    pairs = spread(near).join(far.repartition(tasks, *keys), keys).drop("cell", "__piece")
    d2 = (F.col(lx) - F.col(rx)) * (F.col(lx) - F.col(rx)) + (F.col(ly) - F.col(ry)) * (F.col(ly) - F.col(ry))
    pairs = pairs.withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    return pairs if keep is None else pairs.where(keep)


def knn_join(left: DataFrame, right: DataFrame, lid: str, lxy, rxy, tie: list[str], k: int = 1, radius: float | None = None) -> DataFrame:
    """The k nearest rows of right for each row of left (lid unique), nearest first, ties by `tie`: rank 1..k.

    Searches within a radius that doubles for the rows that have found fewer than k, until all have, or
    the radius spans everything. It starts at twice what k rows of right take up on average, or at `radius` if
    that is less. What is found and
    what is open is cut each round, so no round repeats the ones before.
    """
    box = right.agg(F.min(rxy[0]), F.max(rxy[0]), F.min(rxy[1]), F.max(rxy[1]), F.count("*")).first()
    own = left.agg(F.min(lxy[0]), F.max(lxy[0]), F.min(lxy[1]), F.max(lxy[1])).first()
    order = Window.partitionBy(lid).orderBy("d2", *tie)
    if not box[4] or own[0] is None or box[0] is None:
        return proximity_join(left, right, lxy, rxy, radius or 1.0).withColumn("rank", F.lit(1).cast("long")).limit(0)
    span = max(box[1], own[1]) - min(box[0], own[0]) + max(box[3], own[3]) - min(box[2], own[2]) + 1
    dense = max(2 * ((box[1] - box[0] + 1) * (box[3] - box[2] + 1) * k / box[4]) ** 0.5, span / 2**20)
    radius = min(radius or dense, dense)
    found, open_ = None, left
    while True:
        near = cut(proximity_join(open_, right, lxy, rxy, radius).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k))
        done = near if radius >= span else near.join(near.where(F.col("rank") == k).select(lid), lid, "left_semi")
        found = done if found is None else found.unionByName(done)
        if radius >= span:
            return found
        open_ = cut(open_.join(near.where(F.col("rank") == k).select(lid), lid, "left_anti"))
        if open_.isEmpty():
            return found
        radius *= 2


def nearest_on_sphere(left: DataFrame, right: DataFrame, lid: str, lxy, rxy, degree: float, on: tuple[str, ...] = ()) -> DataFrame:
    """(lid, metres): of each row of left the great-circle metres to the nearest row of right with equal `on`; rows without one
    are left out. Coordinates are numbers, so many to a degree of longitude and latitude.

    A round looks at the nine cells around a row. What it finds holds once everything nearer must lie in them: a circle of
    that many metres spans so many degrees either way. Rows without such an answer go on with cells twice as wide."""
    (lx, ly), (rx, ry) = lxy, rxy
    left = cut(left.select(lid, *on, lx, ly).where(F.col(lx).isNotNull() & F.col(ly).isNotNull()))
    right = cut(right.select(*on, rx, ry).where(F.col(rx).isNotNull() & F.col(ry).isNotNull()).distinct())
    box, own = (df.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count("*")).first() for df, x, y in ((right, rx, ry), (left, lx, ly)))
    groups = right.select(*on).distinct().count() if on else 1
    if not box[4] or not own[4]:
        return left.select(lid, F.lit(0.0).alias("metres")).limit(0)
    span = max(box[1], own[1]) - min(box[0], own[0]) + max(box[3], own[3]) - min(box[2], own[2]) + 1
    radius = max(2 * ((box[1] - box[0] + 1) * (box[3] - box[2] + 1) * max(groups, 1) / box[4]) ** 0.5, span / 2**20)
    at = lambda x, y: point(F.col(x) / degree, F.col(y) / degree)
    found, open_ = None, left
    while True:
        pairs = spread(with_cells(open_, lx, ly, radius, around=True)).join(with_cells(right, rx, ry, radius), ["cell", *on])
        near = cut(pairs.groupBy(lid, ly).agg(F.min(haversine(at(lx, ly), at(rx, ry))).alias("metres")))
        if radius >= span:
            last = near.select(lid, "metres")
            return last if found is None else found.unionByName(last)
        # how far a circle of the metres reaches in latitude and longitude, with a little to spare
        arc, lat = F.col("metres") / EARTH * (1 + 1e-9) + 1e-12, F.radians(F.col(ly) / degree)
        wide = F.when((arc + F.abs(lat) < F.lit(1.57)) & (F.sin(arc) < F.cos(lat)), F.degrees(F.asin(F.sin(arc) / F.cos(lat))))
        done = near.where((F.degrees(arc) * degree <= radius) & (wide * degree <= radius)).select(lid, "metres")
        found = done if found is None else found.unionByName(done)
        open_ = cut(open_.join(done.select(lid), lid, "left_anti"))
        if open_.isEmpty():
            return found
        radius *= 2


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, take: list[str]) -> DataFrame:
    """Each left row with the columns `take` of the latest right row of its key at or before it (nulls if none).
    Ties among right rows: the greatest by `take`. One shuffle: both sides are one sorted stream."""
    fields = [F.col(c) for c in take]
    a = left.select(*by, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*fields)).schema[0].dataType).alias("__take"))
    b = right.select(*by, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__row"), F.struct(*fields).alias("__take"))
    order = Window.partitionBy(*by).orderBy("__at", "__side", "__take").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__last", F.last("__take", ignorenulls=True).over(order)).where("__side = 1")
    return both.select("__row.*", *[F.col("__last").getField(c).alias(c) for c in take])


def interval_overlap_join(left: DataFrame, right: DataFrame, on: list[str], l_span, r_span, width: float) -> DataFrame:
    """Pairs of equal `on` whose half-open intervals overlap (a.lo < b.hi and b.lo < a.hi).

    An interval has a level: 0 up to `width`, one more for each doubling. At its own level and above it lies in two
    buckets at most, of width * 2^level, so a long interval isn't cut into many. A pair meets at the higher of
    its levels, and is given once, in the bucket where its overlap begins. There the longer one stands alone against
    the other side's rows raised to it, so short intervals never meet one another in the buckets of a long one.
    """
    (la, lb), (ra, rb) = l_span, r_span
    level = lambda a, b: F.greatest(F.ceil(F.log2((F.col(b) - F.col(a)) / width)), F.lit(0)).cast("int")
    left = left.where(F.col(la) < F.col(lb)).withColumn("__own", level(la, lb))
    right = right.where(F.col(ra) < F.col(rb)).withColumn("__own", level(ra, rb))
    own = lambda df: sorted(r[0] for r in df.select("__own").distinct().collect())  # noqa: E731  a number for each doubling
    l_levels, r_levels = own(left), own(right)

    def buckets(df, levels, a, b):
        w = F.lit(width) * F.pow(F.lit(2), F.col("level"))
        return df.withColumn("level", levels).drop("__own").withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / w), F.ceil(F.col(b) / w) - 1)))

    def raised(others, least):  # the levels of the other side's rows that are longer
        return F.explode(F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k >= least))

    out = None
    for a, b in ((F.col("__own"), raised(l_levels, F.col("__own"))), (raised(r_levels, F.col("__own") + 1), F.col("__own"))):
        # the first: a left row as long or longer, at its own level; the second: a right row that is longer
        pairs = buckets(left, a, la, lb).join(buckets(right, b, ra, rb), [*on, "level", "bucket"])
        first = F.floor(F.greatest(la, ra) / (F.lit(width) * F.pow(F.lit(2), F.col("level"))))
        met = pairs.where((F.col(la) < F.col(rb)) & (F.col(ra) < F.col(lb)) & (F.col("bucket") == first)).drop("level", "bucket")
        out = met if out is None else out.unionByName(met)
    return out


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by a total order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def unpaired(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a without a partner in b, and of b without one in a."""
    return a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")


def semi_fraction(samples: DataFrame, hits: DataFrame, group: list[str], keys: list[str], share: float) -> DataFrame:
    """Groups of samples of which at least `share` have a partner among hits: group, n, n_hit."""
    flagged = samples.join(hits.select(*keys).distinct().withColumn("__hit", F.lit(1)), keys, "left")
    counted = flagged.groupBy(*group).agg(F.count("*").alias("n"), F.count("__hit").alias("n_hit"))
    return counted.where(F.col("n_hit") >= share * F.col("n"))


def changed(a: Column, b: Column) -> Column:
    """IS DISTINCT FROM."""
    return ~a.eqNullSafe(b)
