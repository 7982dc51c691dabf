"""SimHash near-duplicates found through a table of distances to reference fingerprints.

Reference fingerprints ("pivots") are zero, 32 masks of two neighbouring bits,
and a few spread-out values. For a pivot p, |d(x,p) - d(y,p)| <= d(x,y). The
distances to zero and to mask j give t_j = bits of x inside mask j
(t_j = (d(x,0) + 2 - d(x,p_j)) / 2), and the t_j of two fingerprints differ by
at most d(x,y) in sum. So at two or fewer differing bits at most two of four
groups of eight masks have other coordinates, and some two groups agree: the
six pairs of groups are join keys that lose no link. Partners that meet under a
key are discarded when any coordinate of the remaining table differs by more
than the radius, and survivors are verified bit by bit.

A key with many members (a large group of near copies) isn't expanded into
pairs: each member lists the 65 fingerprints within one bit of it, and two
fingerprints are within two bits exactly if they list a common one, so links to
the smallest member of each such list connect the same groups.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.operators.graph import components
from roadweave.session import cut

RADIUS = 2
SHINGLE = 3
SMALL = 24  # members of a key that are paired directly; larger ones go by common neighbours
MASKS = [3 << (2 * j) for j in range(32)]
GROUPS = [range(8 * g, 8 * g + 8) for g in range(4)]
SPREAD = [(0x9E3779B97F4A7C15 * (k + 1)) % 2**64 for k in range(8)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([h(joined, 42)], np.uint64)
    ends = list(accumulate([len(w) + 1 for w in words]))
    return np.array([h(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :])], np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bit i is 1 if over half of the shingle hashes have it; no words: 0."""
    return majority(shingle_hashes(text, width))


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if over half of the hashes have it. Long texts are counted part by part."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of each row's whole text. Null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [signed(fingerprint(t or b"", width)) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds near: distances to the spread pivots, and keys: the group coordinates in pairs."""
    zero = distance(F.col("fp"), F.lit(0).cast("long"))
    inside = lambda j: ((zero + 2 - distance(F.col("fp"), F.lit(signed(MASKS[j])))) / 2).cast("int")
    group = [sum((inside(j) * 3**k for k, j in enumerate(g)), F.lit(0)) for g in GROUPS]
    keyed = fps.withColumns({f"g{i}": g for i, g in enumerate(group)} | {"near": F.array(*[distance(F.col("fp"), F.lit(signed(p))).cast("byte") for p in SPREAD])})
    keys = [F.struct(F.lit(k).alias("k"), F.col(f"g{a}").alias("a"), F.col(f"g{b}").alias("b")) for k, (a, b) in enumerate(combinations(range(4), 2))]
    return keyed.withColumn("keys", F.array(*keys)).drop("g0", "g1", "g2", "g3")


def links(fps: DataFrame) -> DataFrame:
    """(node, fp) with distinct fp -> links (u, v) that connect what lies within RADIUS bits."""
    rows = pivot_table(fps).select("node", "fp", "near", F.explode("keys").alias("key"))
    met = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = cut(rows.join(met, "key").select("node", "fp", "near", "n", F.xxhash64("key").alias("key")))
    few = live.where(F.col("n") <= SMALL)
    a = few.select("key", F.col("fp").alias("fa"), F.col("node").alias("u"), F.col("near").alias("na"))
    b = few.select("key", F.col("fp").alias("fb"), F.col("node").alias("v"), F.col("near").alias("nb"))
    apart = F.array_max(F.zip_with("na", "nb", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    pairs = a.join(b, "key").where((F.col("fa") < F.col("fb")) & (apart <= RADIUS) & (distance(F.col("fa"), F.col("fb")) <= RADIUS)).select("u", "v")
    # each becomes 65 rows: spread out first, whatever the partitions of the checkpoint
    many = live.where(F.col("n") > SMALL).select("node", "fp").distinct().repartition("fp")
    around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    points = many.select("node", F.explode(around).alias("point"))
    centre = points.groupBy("point").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
    through = points.join(centre, "point").select(F.col("node").alias("u"), "v").where("u != v")
    return pairs.unionByName(through)


def near_duplicates(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs(doc_id, text).

    Texts with equal fingerprints belong together, whatever their number; null
    and empty texts have fingerprint 0 and link like any other. Rows that repeat
    a doc_id are each answered. An empty table gives an empty table. Columns
    other than doc_id and text aren't looked at.
    """
    each = cut(fingerprints(docs, width))
    fps = cut(each.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(fps))
    group = fps.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return each.join(group, "fp").select("doc_id", "fp", "component_id")


# Near copies: five-word shingles, Jaccard similarity of 0.8 or more.

COPY_SHINGLE, SIMILARITY, COPY_RADIUS, KEYS = 5, 0.8, 26, 8
SMALL_SET = 500_000  # lists of up to so many ids are broadcast
SEEDS = [xxhash.xxh64_intdigest(bytes([k])) for k in range(KEYS)]


def permuted(h: np.ndarray, seed: int) -> np.ndarray:
    """A permutation of 64-bit numbers; multiples of one another would all have the same smallest element."""
    z = (h ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, body: hash of the words, keys: array<long> of KEYS smallest permuted shingle hashes)."""

    def run(batches):
        for batch in batches:
            fps, bodies, keys = [], [], []
            for t in batch.column(1).cast(pa.large_binary()).to_pylist():
                h = np.unique(shingle_hashes(t or b"", COPY_SHINGLE))
                bodies.append(signed(xxhash.xxh3_64_intdigest(b" ".join((t or b"").lower().split()))))
                if len(h):
                    fps.append(signed(majority(h)))
                    keys.append([int(permuted(h, seed).min().view(np.int64)) for seed in SEEDS])
                else:
                    fps.append(0)
                    keys.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), pa.array(bodies, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "fp", "body", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, body long, keys array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or b"", COPY_SHINGLE)).view(np.int64) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "s"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, s array<long>")


def few(df: DataFrame) -> DataFrame:
    """Broadcast up to SMALL_SET rows of ids; beyond, Spark's own choice."""
    return F.broadcast(df) if df.count() <= SMALL_SET else df


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sets have a Jaccard similarity of SIMILARITY or more."""
    both = pairs.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v")
    common = F.size(F.array_intersect("su", "sv"))
    return both.where(common >= SIMILARITY * (F.size("su") + F.size("sv") - common)).select("u", "v")


def unmet(sets: DataFrame, found: DataFrame) -> DataFrame:
    """sets(node, s), found(node, component) -> pairs (u, v) of different components, among them all of SIMILARITY or more.

    Each set is ordered by how many of the sets hold a shingle. Two sets of n <= m shingles at similarity t have
    t / (1 + t) * (n + m) or more in common, so the first common one is among the first n / 9 (t = 0.8) of the smaller
    and the first m / 5 of the larger, and as many must follow it in both. Members of one component needn't meet: under
    a shingle those of its most frequent component meet only the others.
    """
    each = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("h"))
    held = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    order = each.join(held, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o")).withColumn("alone", F.col("n") - F.size("o"))
    first = lambda share: F.floor(F.col("n") * share + 1e-9).cast("int")
    rows = order.select("node", "n", "alone", F.posexplode(F.slice("o", F.lit(1), F.greatest(first(1 - SIMILARITY) + 1 - F.col("alone"), F.lit(0)))).alias("at", "x"))
    rows = rows.select("node", "n", (F.col("alone") + F.col("at")).alias("at"), "x.h").join(found, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
    rows = cut(rows)
    top = rows.groupBy("h", "g").agg(F.count("*").alias("c")).groupBy("h").agg(F.max(F.struct("c", "g")).alias("top"), F.count("*").alias("groups")).where("groups > 1")
    live = rows.join(top.select("h", "top.g").toDF("h", "most"), "h").withColumn("other", F.col("g") != F.col("most"))
    meets = F.when(F.col("other"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
    a = live.where(F.col("at") <= first((1 - SIMILARITY) / (1 + SIMILARITY))).select("h", F.explode(meets).alias("other"), F.col("node").alias("u"), F.col("n").alias("nu"), F.col("at").alias("pu"), F.col("g").alias("gu"))
    b = live.select("h", "other", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("at").alias("pv"), F.col("g").alias("gv"))
    sized = (F.col("nu") < F.col("nv")) | ((F.col("nu") == F.col("nv")) & (F.col("u") < F.col("v")))
    enough = F.least(F.col("nu") - F.col("pu"), F.col("nv") - F.col("pv")) >= SIMILARITY / (1 + SIMILARITY) * (F.col("nu") + F.col("nv")) - 1e-6
    return a.join(b, ["h", "other"]).where((F.col("gu") != F.col("gv")) & sized & enough).select("u", "v").distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component): documents of equal words, and chains of documents whose five-word shingles
    have a Jaccard similarity of SIMILARITY or more; component is the smallest id of the group.

    Such texts differ in about a sixth of the fingerprint's bits, too many for bit groups to be join keys.
    So partners meet under one of KEYS smallest permuted shingle hashes (two texts at 0.8 miss all of them
    once in 400,000 pairs), the pivot table discards what lies further apart than COPY_RADIUS bits, and the
    exact similarity decides. Under a key that more than SMALL texts share, each text meets the one of
    smallest id and the one nearest to the bitwise majority of their fingerprints; what these leave apart
    among all texts of such keys is joined exactly, without sketches (unmet).

    Texts without words are equal. Rows that repeat a doc_id are one document; null ids stay out.
    """
    each = cut(sketches(docs.where("doc_id is not null")))
    nodes = each.groupBy("body").agg(F.min("doc_id").alias("node"))
    equal = each.join(nodes, "body").select("doc_id", "node").distinct()
    rows = cut(each.join(nodes.withColumnRenamed("node", "doc_id"), ["body", "doc_id"]).dropDuplicates(["body"]).select(F.col("doc_id").alias("node"), "fp", "keys"))
    near = F.array(*[distance(F.col("fp"), F.lit(signed(p))).cast("byte") for p in (0, *MASKS[:8], *SPREAD)])
    keyed = rows.select("node", "fp", near.alias("near"), F.posexplode("keys").alias("k", "v")).withColumn("key", F.xxhash64("k", "v")).drop("k", "v")
    counters = [F.sum(F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"l{k}") for k in range(32)]
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), *counters).where("n > 1")
    met = met.withColumn("lanes", F.array(*[f"l{k}" for k in range(32)])).drop(*[f"l{k}" for k in range(32)])
    middle_bits = F.expr("aggregate(sequence(0, 31), 0L, (all, k) -> all | if(2 * (lanes[k] & 4294967295) > n, shiftleft(1L, k), 0L) | if(2 * shiftrightunsigned(lanes[k], 32) > n, shiftleft(1L, k + 32), 0L))")
    live = cut(keyed.join(met.select("key", "n", "least", middle_bits.alias("middle")), "key"))
    small = live.where(F.col("n") <= SMALL).select("key", "node", "fp", "near")
    a, b = small.toDF("key", "u", "fu", "nu"), small.toDF("key", "v", "fv", "nv")
    pairs = a.join(b, "key").where("u < v")
    large = live.where(F.col("n") > SMALL)
    middle = large.groupBy("key").agg(F.min(F.struct(distance(F.col("fp"), F.col("middle")).alias("d"), "node")).alias("m")).select("key", F.col("m.node").alias("v"))
    leaders = middle.unionByName(large.select("key", F.col("least").alias("v")).distinct()).distinct()
    leaders = leaders.join(large.select("key", F.col("node").alias("v"), F.col("fp").alias("fv"), F.col("near").alias("nv")), ["key", "v"])
    star = large.select("key", F.col("node").alias("u"), F.col("fp").alias("fu"), F.col("near").alias("nu")).join(leaders, "key").where("u != v")
    apart = F.array_max(F.zip_with("nu", "nv", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    wanted = pairs.unionByName(star).where((apart <= COPY_RADIUS) & (distance(F.col("fu"), F.col("fv")) <= COPY_RADIUS))
    wanted = cut(wanted.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    hot = cut(large.select("node").distinct())
    ids = cut(wanted.select(F.col("u").alias("doc_id")).union(wanted.select("v")).union(hot).distinct())
    sets = cut(shingle_sets(docs.join(few(ids), "doc_id")).dropDuplicates(["node"]))
    found = cut(components(alike(wanted, sets)))
    rest = alike(cut(unmet(sets.join(few(hot), "node"), found)), sets)
    met = found.toDF("u", "gu"), found.toDF("v", "gv")
    joined = components(rest.join(met[0], "u", "left").join(met[1], "v", "left").select(F.coalesce("gu", "u").alias("u"), F.coalesce("gv", "v").alias("v")))
    groups = equal.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("node"))
    groups = groups.join(joined, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    return groups.groupBy("doc_id").agg(F.min("component").alias("component"))
