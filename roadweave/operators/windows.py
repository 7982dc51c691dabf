"""Window operators along a line or a time: running sums, islands, rolling ranges, medians by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, by: list[str], order: list, value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def islands(df: DataFrame, by: list[str], order: list, breaks: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows: a new one where `breaks` is true (it may look back with F.lag over the order)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__new", F.when(breaks, 1).otherwise(0)).withColumn(out, F.sum("__new").over(w)).drop("__new")


def previous(column: str, by: list[str], order: list) -> Column:
    return F.lag(column).over(Window.partitionBy(*by).orderBy(*order))


def following(df: DataFrame, by: str, at: str, out: str, stretch: int) -> DataFrame:
    """df with out: the next `at` (a whole number, no two alike) of its group, null for the last. Stretches of so many numbers
    are read apart, then the next of each one's last row is the first of the next stretch that has any, so that a group may be
    as long as the table."""
    own = df.withColumn("__s", F.floor(F.col(at) / stretch))
    inside = own.withColumn(out, F.lead(at).over(Window.partitionBy(by, "__s").orderBy(at)))
    heads = own.groupBy(by, "__s").agg(F.min(at).alias("__first"))
    after = heads.select(by, "__s", F.lead("__first").over(Window.partitionBy(by).orderBy("__s")).alias("__next"))
    return inside.join(after, [by, "__s"], "left").withColumn(out, F.coalesce(out, "__next")).drop("__s", "__next")


def rolling_range(df: DataFrame, by: list[str], at: str, back, ahead, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over all rows from at - back to at + ahead, both included."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-back, ahead)
    return df.withColumns({name: a.over(w) for name, a in aggregates.items()})


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str, out: str = "median") -> DataFrame:
    """Per group the smallest value at which the cumulative weight reaches half of the total. Equal values
    are summed first, so a group is never sorted row by row."""
    sums = df.groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    order = Window.partitionBy(*by)
    run = F.sum("__w").over(order.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__w").over(order)
    return sums.withColumns({"__run": run, "__all": total}).where(2 * F.col("__run") >= F.col("__all")).groupBy(*by).agg(F.min(value).alias(out))


def top_k(df: DataFrame, by: list[str], order: list, k: int, out: str = "rank") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return df.withColumn(out, n).where(F.col(out) <= k)


def evict(df: DataFrame, by: list[str], newest_first: list, size: str, cap: int) -> DataFrame:
    """Rows to delete so that the newest of each `by` fit in `cap` bytes: those past the cap."""
    w = Window.partitionBy(*by).orderBy(*newest_first).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("held", F.sum(size).over(w)).where(F.col("held") > cap)


# The kept reads of a feed and what makes a read doubtful.
COUNTS_KEPT, USUAL_AFTER, EMPTY_USUAL, SHRUNK_USUAL, SHRUNK_SHARE = 8, 3, 5, 20, 0.2


def usual_count(counts: Column) -> Column:
    """Upper median of an array of kept counts; null with too few."""
    kept = F.sort_array(F.filter(counts, lambda c: c.isNotNull()))
    return F.when(F.size(kept) >= USUAL_AFTER, F.get(kept, F.floor(F.size(kept) / 2).cast("int")))


def doubt(usual: Column, found: Column) -> Column:
    """'empty' or 'shrunk' where a read of `found` items isn't to be believed, else null."""
    return F.when((found == 0) & (usual >= EMPTY_USUAL), "empty").when((found > 0) & (usual >= SHRUNK_USUAL) & (found < usual * SHRUNK_SHARE), "shrunk")


def rolling_score(pieces: DataFrame, points: DataFrame, samples: DataFrame, route: str, window: float) -> DataFrame:
    """pieces(route, start, end, ratio; null where not rated), points(route, at, worth), samples(route, at) -> samples with
    score: what pieces (metres times ratio) and points are worth within half of `window` either side of a sample, by rated
    metre; null where none is rated. Pieces of a route don't overlap, may leave holes, and are cut where the window is; the
    window is cut at the route's ends. Points on the window's edges count.

    One stream a route, sorted once: running sums at both edges of each window, read between pieces by interpolation."""
    end = pieces.groupBy(route).agg(F.max("end").alias("__end"))
    edges = samples.join(end, route).select(route, "at", F.explode(F.array(*[F.struct(x.alias("m"), F.lit(side).alias("side")) for x, side in ((F.greatest(F.lit(0.0), F.col("at") - window / 2), 1), (F.least(F.col("__end"), F.col("at") + window / 2), 3))])).alias("e")).distinct()
    none = F.lit(None)
    length, rated = F.col("end") - F.col("start"), F.col("ratio").isNotNull()
    a = pieces.select(route, F.col("start").alias("m"), F.lit(0).alias("side"), F.struct("start", "end", "ratio").alias("piece"), F.when(rated, length).otherwise(0.0).alias("rated"), F.when(rated, length * F.col("ratio")).otherwise(0.0).alias("calm"), F.lit(0.0).alias("worth"), none.cast("double").alias("at"))
    empty = none.cast(a.schema["piece"].dataType)
    b = edges.select(route, "e.m", "e.side", empty.alias("piece"), *[F.lit(0.0).alias(c) for c in ("rated", "calm", "worth")], "at")
    c = points.select(route, F.col("at").alias("m"), F.lit(2).alias("side"), empty.alias("piece"), F.lit(0.0).alias("rated"), F.lit(0.0).alias("calm"), F.col("worth").cast("double").alias("worth"), none.cast("double").alias("at"))
    w = Window.partitionBy(route).orderBy("m", "side").rowsBetween(Window.unboundedPreceding, 0)
    run = a.unionByName(b).unionByName(c).withColumns({"__p": F.last("piece", ignorenulls=True).over(w), "__r": F.sum("rated").over(w), "__c": F.sum("calm").over(w), "__w": F.sum("worth").over(w)}).where("side IN (1, 3)")
    # of the last piece begun only what lies before the edge
    over = F.greatest(F.coalesce(F.col("__p.end") - F.col("m"), F.lit(0.0)), F.lit(0.0))
    known = F.col("__p.ratio").isNotNull()
    read = run.select(route, "at", "side", (F.col("__r") - F.when(known, over).otherwise(0.0)).alias("r"), (F.col("__c") - F.when(known, over * F.col("__p.ratio")).otherwise(0.0) + F.col("__w")).alias("v"))
    signed = lambda x: F.sum(F.when(F.col("side") == 3, F.col(x)).otherwise(-F.col(x)))
    got = read.groupBy(route, "at").agg(signed("r").alias("r"), signed("v").alias("v"))
    return samples.join(got.select(route, "at", F.when(F.col("r") > 1e-9, F.col("v") / F.col("r")).alias("score")), [route, "at"], "left")


def peaks(scored: DataFrame, route: str) -> DataFrame:
    """(route, at, score) of each route's highest score, the first of a tie; routes without a score are left out."""
    best = scored.where("score IS NOT NULL").groupBy(route).agg(F.max(F.struct("score", (-F.col("at")).alias("b"))).alias("m"))
    return best.select(route, (-F.col("m.b")).alias("at"), "m.score")
