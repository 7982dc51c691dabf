"""Mixing sources to target weights along a time-varying curriculum, natively.

Every source has a target in words: water-filling of the total by weight, a
source being worth at most CAP times its size. A source's documents, in a fixed
pseudo-random order, form a stream that repeats until the target is reached; the
last copy is cut there, so the words taken equal the target. A schedule says how
a source's weight changes over training: it is integrated to a cumulative demand,
and the demand is inverted to give each copy's position in [0, 1]. Documents are
range-sorted by position.

A source may hold most rows: prefix sums are taken inside (source, bucket) groups
of a hash order and over the bucket totals, never over a source as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.session import cut

SPACE = r"[\x20\x09-\x0D]"
WEIGHTS = (1, 2, 3)
CAP = 3
PLAN_ROWS = 200_000  # a plan of up to so many rows (about 60 bytes each) is broadcast
#: Per class of weight, knots (time, relative weight) of a piecewise linear schedule with mean 1.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null and empty: 0."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE + "+"))).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, bucket, size) -> (source, class, source_size, target): one row per source.

    There are as many rows as sources; ordering them is the only global step.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    rows = total.withColumn("class", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1))
    # the level rises until all is shared: sources are full in the order of size over weight
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns(
        {
            "left": F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # the first source that isn't full at the level it would set, gives the level
    rows = rows.withColumn("level", F.col("left").cast("double") / F.col("open"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)
    target = F.least(F.col("weight") * F.coalesce(level["level"], F.lit(0.0)), (cap * F.col("source_size")).cast("double"))
    return rows.select("source", "class", "source_size", target.alias("target"))


def position(share: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """Time at which a source of this class of schedule has met this share of its demand."""
    found = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        whole = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        done, pieces = 0.0, F.lit(None).cast("double")
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area = (t1 - t0) * (w0 + w1) / 2
            rest, slope = F.greatest(share * whole - done, F.lit(0.0)), (w1 - w0) / (t1 - t0)
            # w0 x + slope x^2 / 2 = rest
            x = 2 * rest / (w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
            pieces = F.coalesce(pieces, F.when(share * whole <= done + area, t0 + x))
            done += area
        found = F.when(kind == k, F.coalesce(pieces, F.lit(1.0))).otherwise(found)
    return found


def mix(docs: DataFrame, keep=(), weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """docs(doc_id, text, source) -> one row per row of docs: doc_id, source, size,
    source_size, target, start (of its first copy in its source's stream), taken, position.

    Null and empty texts have size 0 and are taken 0 words; a null source is a
    source of its own, last in order. Rows that repeat a doc_id count as documents;
    ties in the order are between equal rows. An empty table gives an empty table. Words of
    very long texts are all counted. Columns other than these and keep's aren't looked at.
    keep: further columns of docs to carry along.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), *keep)
    order = F.md5(F.col("doc_id").cast("string"))
    sized = sized.withColumns({"order": order, "bucket": F.substring(order, 1, 3)})
    if not keep:  # narrow rows: sizes are read twice, texts once
        sized = cut(sized)
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0))).drop("size")
    targets = source_targets(sums, weights, cap)
    # structs, as keys, are equal where both sources are null
    plan = buckets.withColumn("key", F.struct("source")).join(targets.withColumn("key", F.struct("source")).drop("source"), "key")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.select("key", "bucket", "ahead", "class", "source_size", "target")
    if keep:  # wide rows: they stay where they are if the plan, a row for each source and bucket, is small
        plan = cut(plan)
        plan = F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan
    rows = sized.withColumn("key", F.struct("source")).join(plan, ["key", "bucket"])
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    start = F.col("ahead") + F.col("before")
    whole = F.floor("target")
    copy = lambda e: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), whole - start - e * F.col("source_size")))
    taken = sum((copy(e) for e in range(1, cap)), copy(0))
    share = F.when(F.col("target") > 0, start / F.col("target")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "source", "size", "class", "source_size", "target", start.alias("start"), taken.cast("long").alias("taken"), position(F.least(share, F.lit(1.0)), F.col("class") % len(schedules), schedules).alias("position"), *keep)


def mixed_documents(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """docs (doc_id, text, source and others) as the mix takes them, in training order: a row for each
    copy, with docs' columns. The copy that reaches a source's target holds its first words only.

    Documents without words (null, empty) aren't taken. Rows that repeat a doc_id are documents each. Columns of
    any other name are carried unchanged; an empty table gives an empty table."""
    columns = docs.columns
    kept = docs.select(F.struct(*columns).alias("document"), "doc_id", "text", "source")
    mixed = mix(kept, ("document",), weights, cap, schedules).where("taken > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    share = F.least((F.col("start") + F.col("copy") * F.col("source_size")) / F.col("target"), F.lit(1.0))
    placed = copies.select("document", "doc_id", "size", words.alias("words"), position(share, F.col("class") % len(schedules), schedules).alias("position"))
    text = F.col("document.text")
    # pieces of white space and a word
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")).otherwise(text)
    other = {"text": first} | ({"n_chars": F.char_length(first).cast("long")} if "n_chars" in columns else {})
    rows = placed.orderBy("position", "doc_id").select(*[(other[c] if c in other else F.col("document").getField(c)).alias(c) for c in columns])
    return rows
