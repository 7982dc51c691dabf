"""Benchmark decontamination by SimHash fingerprints of item-sized windows, with DataFrame functions only.

Words are lower-cased runs of letters, digits and marks; shingles are five words
(a shorter text: all its words), weighted by how often they occur. A window of a
document has as many words as a benchmark item. The similarity of a window and an
item of its size is the weight of the item's shingles found in the window, over
all of the item's weight; from 0.8 the document leaks the item.

Where windows stand: a text that holds 0.8 of an item's m shingles holds at least
one of any floor(0.2 m) + 1 of them. The item's anchors are those that the
fewest items have; texts without any anchor can't reach the threshold. Around
an anchor, a window is formed where the anchor has the same place in both, and
wherever the item's shingles stand close enough: a window that reaches the
threshold can be moved on to the next shingle of the item without losing one, and
from there as many of the item's shingles as the threshold asks for lie within
its length. So words put in, left out or changed anywhere move no window out of sight.

Which items a window is compared with: the SimHash of its shingles is looked up
in a multi-index of the items' fingerprints, BLOCKS blocks of 64 / BLOCKS bits
with every block value within one bit listed too. Fingerprints within RADIUS bits
agree in some block up to one bit, so none of these is missed. Windows at a
similarity of only 0.8 differ in about 13 bits and up to 28, where no block is
selective: for them the item whose anchor formed the window is a candidate as
well. The exact similarity verifies all candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadweave.session import cut

SHINGLE = 5
SIMILARITY = 0.8
#: Anchors of a benchmark up to this many rows (24 bytes each) are broadcast; beyond it both sides shuffle.
BROADCAST_ROWS = 500_000
PART = 4096  # first words of the windows that a document's row is sent for
BLOCKS = 4
RADIUS = 2 * BLOCKS - 1  # of this many differing bits, some block has at most one
SPLIT = r"[^\p{L}\p{N}\p{M}]+"


def with_shingles(df: DataFrame, text: str, width: int = SHINGLE) -> DataFrame:
    """Adds n_words and s: hashes of the shingles in order. No words: an empty array."""
    df = df.withColumn("w", F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), f"^{SPLIT}|{SPLIT}$", ""), SPLIT))
    n = F.when(F.get("w", F.lit(0)) == "", F.lit(0)).otherwise(F.size("w"))
    gram = lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(width)])
    few = F.when(F.get("w", F.lit(0)) == "", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64("w")))
    s = F.when(F.size("w") >= width, F.transform(F.sequence(F.lit(0), F.size("w") - width), gram)).otherwise(few)
    return df.withColumns({"n_words": n, "s": s}).drop("w")


def simhashes(shingles: DataFrame, key: list[str]) -> DataFrame:
    """(key..., h, n: occurrences) -> (key..., fp, weight). A window holds under 2^31 shingles.

    Lane k of 32 counts bit k in its lower half and bit k + 32 in its upper half.
    """
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(0x0000000100000001)) * F.col("n")).alias(f"l{k}") for k in range(32)]
    sums = shingles.groupBy(*key).agg(*lanes, F.sum("n").alias("weight"))
    sums = sums.withColumn("lanes", F.array(*[f"l{k}" for k in range(32)]))
    bit = "if(2 * {ones} > weight, shiftleft(1L, k + {at}), 0L)"
    low, high = bit.format(ones="(lanes[k] & 4294967295)", at=0), bit.format(ones="shiftrightunsigned(lanes[k], 32)", at=32)
    fp = F.expr(f"aggregate(sequence(0, 31), 0L, (all, k) -> all | {low} | {high})")
    return sums.select(*key, fp.alias("fp"), "weight")


def blocks(fp, near: bool):
    """The numbers of a fingerprint's blocks, each with its place; near: and all those one bit away."""
    bits = 64 // BLOCKS
    flips = [0, *(1 << i for i in range(bits))] if near else [0]
    value = lambda k: F.shiftrightunsigned(fp, k * bits).bitwiseAND(F.lit((1 << bits) - 1))
    return F.array(*[F.struct(F.lit(k).alias("k"), value(k).bitwiseXOR(F.lit(x)).alias("v")) for k in range(BLOCKS) for x in flips])


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, start, n_words, differing, similarity): per document and item its most similar window.

    start is the first word of the window. An item of under five words is found only where it is a whole
    document: inside others its few words mean nothing. Null, empty and wordless texts and items match nothing. Rows that
    repeat a doc_id or an item_id are one document or item if their texts are equal; of differing texts each
    is searched under the same id. Of windows that are equally similar, the first stands. Either table may be
    empty. Very long texts are searched whole: their windows are dealt in parts of PART words. Other columns
    aren't looked at.
    """
    items = with_shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "text", width).where("n_words > 0")
    items = items.withColumn("item", F.struct("item_id", F.xxhash64("text").alias("h"))).select("item", "n_words", F.posexplode_outer("s").alias("q", "h"))
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    weights = cut(items.groupBy("item", "n_words", "h").agg(F.count("*").cast("int").alias("n"), F.min("q").alias("q")))
    prints = cut(simhashes(weights, ["item", "n_words"])).withColumnRenamed("weight", "whole")
    held = weights.groupBy("h").agg(F.count("*").alias("held"))
    rank = Window.partitionBy("item", "n_words").orderBy("held", "q")
    # a shingle that the item has n times takes n of the floor(0.2 m) + 1 places
    before = F.coalesce(F.sum("n").over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = weights.join(held, "h").withColumn("before", before).join(prints.select("item", "n_words", "whole"), ["item", "n_words"])
    chosen = chosen.where(F.col("before") <= F.floor(F.col("whole") * (1 - similarity) + 1e-9)).select("item", "n_words", "h")
    anchors = cut(items.join(chosen, ["item", "n_words", "h"]).select("item", "n_words", "q", "h"))

    doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h")).alias("doc")
    texts = docs.select(doc, "text")
    # explode_outer: a filter on the array, which explode implies, would be pushed down and form the shingles anew
    hits = with_shingles(texts, "text", width).select("doc", F.posexplode_outer("s").alias("p", "h")).join(small(anchors), "h")
    starts = cut(hits.select("doc", F.greatest(F.col("p") - F.col("q"), F.lit(0)).alias("start"), "n_words", "item").distinct())
    parts = starts.select("doc", (F.col("start") / PART).cast("int").alias("part"), "start", "n_words").distinct()
    by_doc = cut(parts.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "n_words")).alias("windows")))
    # the shingles around each anchor, from its document again: all of every window that has the anchor inside
    again = with_shingles(texts.join(small(by_doc), "doc").dropDuplicates(["doc", "part"]), "text", width)
    size = F.greatest(F.col("n_words") - width + 1, F.lit(1))
    around = again.withColumn("window", F.explode("windows")).select("doc", "window.start", F.col("window.n_words").alias("n_words"), "s", F.size("s").alias("all")).where(F.col("start") < F.col("all"))
    around = around.withColumn("low", F.greatest(F.col("start") - size + 1, F.lit(0)))
    around = around.select("doc", "n_words", "all", "low", F.posexplode(F.slice("s", F.col("low") + 1, F.col("start") + 2 * size - F.col("low"))).alias("p", "h"))
    around = cut(around.select("doc", "n_words", "all", (F.col("low") + F.col("p")).alias("p"), "h").distinct())
    # from one of the item's shingles as many as it takes, within its length
    of_item = ["doc", "item", "n_words"]
    own = around.join(starts.select(*of_item).distinct(), ["doc", "n_words"]).join(small(weights.select("item", "n_words", "h")), ["item", "n_words", "h"])
    own = cut(own.withColumn("k", F.row_number().over(Window.partitionBy(*of_item).orderBy("p"))))
    takes = prints.select("item", "n_words", F.greatest(F.ceil(F.col("whole") * similarity - 1e-9), F.lit(1)).alias("takes"))
    first = own.join(small(takes), ["item", "n_words"]).select(*of_item, "all", "p", (F.col("k") + F.col("takes") - 1).alias("k"))
    close = first.join(own.select(*of_item, "k", F.col("p").alias("end")), [*of_item, "k"]).where(F.col("end") - F.col("p") < size)
    starts = cut(starts.unionByName(close.select("doc", F.least(F.col("p"), F.greatest(F.col("all") - size, F.lit(0))).alias("start"), "n_words", "item")).distinct())
    window = ["doc", "start", "n_words"]
    # a window meets the shingles of its own block of positions and of the next
    block = lambda c: F.floor(F.col(c) / size)
    windows = starts.select(*window).distinct().withColumn("block", F.explode(F.array(block("start"), block("start") + 1)))
    inside = windows.join(around.withColumn("block", block("p")).drop("all"), ["doc", "n_words", "block"]).where((F.col("p") >= F.col("start")) & (F.col("p") < F.col("start") + size))
    inside = cut(inside.groupBy(*window, "h").agg(F.count("*").cast("int").alias("n")))
    found = cut(simhashes(inside, window).select(*window, "fp"))

    listed = prints.select("item", "n_words", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), True)).alias("block"))
    asked = found.select(*window, "fp", F.explode(blocks(F.col("fp"), False)).alias("block"))
    near = asked.join(small(listed), ["n_words", "block"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    wanted = near.select(*window, "item").unionByName(starts.select(*window, "item")).distinct()

    shared = inside.join(wanted, window).join(small(weights.select("item", "n_words", "h", F.col("n").alias("wanted"))), ["item", "n_words", "h"])
    alike = shared.groupBy(*window, "item").agg(F.sum(F.least("n", "wanted")).alias("common"))
    alike = alike.join(small(prints.withColumnRenamed("fp", "item_fp")), ["item", "n_words"]).withColumn("similarity", F.col("common") / F.col("whole")).where(F.col("similarity") >= similarity)
    alike = alike.join(found, window).withColumn("differing", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
    best = alike.groupBy("doc.doc_id", "item.item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "n_words", "differing")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.differing").cast("long").alias("differing"), (-F.col("best.s")).alias("similarity"))
