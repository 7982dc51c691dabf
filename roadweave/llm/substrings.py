"""Substring deduplication: words covered by a window of WINDOW words that also starts earlier.

1. Each window has an anchor: the smallest of its K-word hashes. Equal windows have
   equal anchors. Anchors that occur once are done. Of documents with one and the
   same text, all after the first lose all windows, and the first stands for them.
2. Windows in a row with one anchor (up to SPAN) make a passage. Equal passages are
   one, with the earliest place, first inside each task and then where they are dealt
   out by anchor, so that equal windows meet in one shard.
3. A shard builds compressed FM-indexes of whole anchors' passages and streams the
   passages through them: backward search over the wavelet matrix gives, for every
   window, the interval of suffixes that begin with it, and so its earliest place.
   The index's symbols are runs of STRIDE words, laid out so that a window is
   WINDOW / STRIDE symbols in a row.
4. Documents drop the words of windows whose earliest place is before their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.fmindex import FMIndex
from roadweave.session import cut

WINDOW, K, STRIDE = 20, 5, 5
SPAN = WINDOW - K + 1
INDEX_WORDS = 400_000  # an index holds about so many words, but always all of an anchor's
COMBINE = 50_000  # passages that a task combines before it sends them
ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in words], np.uint64)


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of up to SPAN windows with one anchor: anchor, first window, number of windows; and all K-word hashes."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    grams = len(hashes) - K + 1
    g = np.zeros(grams, np.uint64)
    for j in range(K):
        g += hashes[j : j + grams] * np.uint64(ODD[j])
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    every, width = g.astype(np.int64), 1
    while width * 2 <= SPAN:
        g = np.minimum(g[:-width], g[width:])
        width *= 2
    if width < SPAN:
        g = np.minimum(g[: -(SPAN - width)], g[SPAN - width :])
    new = np.concatenate([[True], g[1:] != g[:-1]])
    run = np.flatnonzero(new)
    start = np.flatnonzero((np.arange(n) - run[np.cumsum(new) - 1]) % SPAN == 0)
    return g[start].astype(np.int64), start, np.diff(start, append=n), every


def earliest(passages: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per passage and window, the earliest place (document, word) of an equal window among all passages."""
    words = [p.split() for p in passages]
    size = np.array([len(w) for w in words])
    flat = word_hashes([w for ws in words for w in ws])
    ends = np.cumsum(size)
    begin = ends - size
    owner = np.repeat(np.arange(len(words)), size)
    inside = np.arange(len(flat)) - begin[owner]
    ids = np.unique(flat, return_inverse=True)[1].astype(np.int64)

    def paired(a, b, gap):
        n = min(len(a), len(b) - gap)
        return np.unique(a[:n] * (int(b.max(initial=0)) + 1) + b[gap : gap + n], return_inverse=True)[1].astype(np.int64)

    five = paired(paired(paired(ids, ids, 1), paired(ids, ids, 1), 2), ids, 4) + 1
    whole = np.flatnonzero(inside[: len(five)] + STRIDE <= size[owner[: len(five)]])
    # passages laid out by the word number modulo STRIDE, a separator after each part
    part = owner[whole] * STRIDE + inside[whole] % STRIDE
    order = np.lexsort([whole, part])
    source, part = whole[order], part[order]
    breaks = np.cumsum(np.concatenate([[0], part[1:] != part[:-1]]))
    text = np.zeros(len(source) + int(breaks[-1]) + 1, np.int64)
    place = np.arange(len(source)) + breaks
    text[place] = five[source]
    index = FMIndex(text, WINDOW // STRIDE)
    back = np.full(len(text), -1, np.int64)
    back[place] = source
    where = np.empty(len(flat), np.int64)
    where[source] = place

    windows = np.flatnonzero(inside + WINDOW <= size[owner])
    at = where[windows]
    low, high = index.search(np.stack([text[at + j] for j in range(WINDOW // STRIDE)], axis=1))
    # order of all windows in the corpus, and the smallest within each interval
    doc, start = docs[owner], starts[owner] + inside
    by = np.lexsort([start, doc])
    rank = np.empty(len(flat), np.int64)
    rank[by] = np.arange(len(flat))
    source_of = back[index.suffixes]
    ranks = np.append(np.where(source_of >= 0, rank[source_of], len(flat)), len(flat))
    edges, which = np.unique(low, return_inverse=True)
    tops = np.zeros(len(edges), np.int64)
    tops[which] = high
    least = np.minimum.reduceat(ranks, np.stack([edges, tops], axis=1).ravel())[::2][which]
    found = by[least]
    cuts = np.cumsum(np.maximum(size - WINDOW + 1, 0))[:-1]
    return np.split(doc[found], cuts), np.split(start[found], cuts)


def _anchor_rows(batches):
    """Per document its anchors, each once, and whether their K words stand in it twice."""
    for batch in batches:
        found = [[] for _ in range(4)]
        for i, k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()):
            a, _, _, every = anchors(word_hashes(t.split()))
            each = np.unique(a)
            if len(each):
                place = np.minimum(np.searchsorted(each, every), len(each) - 1)
                n = np.bincount(place[each[place] == every], minlength=len(each))
            else:
                n = each
            for column, v in zip(found, (i, k, each, n > 1)):
                column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())))], names=["id", "short", "anchors", "agains"])


def _each_passage(batch):
    for i, k, t, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), batch.column(3).to_pylist()):
        words, wanted = t.split(), set(wanted)
        for a, start, n in zip(*(x.tolist() for x in anchors(word_hashes(words))[:3])):
            if a in wanted:
                passage = b" ".join(words[start : start + n + WINDOW - 1])
                yield i, k, start, a, xxhash.xxh3_128_digest(passage), passage


def _passage_rows(batches):
    """Where each passage stands, by its key."""
    for batch in batches:
        found = list(zip(*((i, k, start, key) for i, k, start, _, key, _ in _each_passage(batch)))) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["id", "short", "start", "key"])


def _combined_rows(batches):
    """Passages, each with its earliest place so far: once for each COMBINE different ones of a task."""
    first: dict[bytes, tuple] = {}

    def rows():
        columns = list(zip(*((a, key, i, start, passage) for key, (i, start, a, passage) in first.items())))
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "key", "id", "start", "passage"])

    for batch in batches:
        for i, _, start, a, key, passage in _each_passage(batch):
            known = first.get(key)
            if known is None or (i, start) < known[:2]:
                first[key] = (i, start, a, passage)
            if len(first) >= COMBINE:
                yield rows()
                first.clear()
    if first:
        yield rows()


def _shard_rows(batches):
    """Passages by ascending anchor and key -> per passage its earliest place, its number of windows, and the earliest
    places of these; none where each window's is in the passage's own."""
    held: list[tuple] = []
    size, last, latest = 0, None, None

    def index():
        ids, begins = (np.array([h[k] for h in held]) for k in (2, 3))
        docs, starts = earliest([p for _, p, _, _ in held], ids, begins)
        own = [bool((d == i).all() and (s == b + np.arange(len(s))).all()) for d, s, i, b in zip(docs, starts, ids, begins)]
        places = [pa.array([None if o else v for v, o in zip(values, own)], pa.list_(pa.int64())) for values in (docs, starts)]
        return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.binary()), pa.array(ids), pa.array(begins), pa.array(list(map(len, docs)), pa.int32()), *places], names=["key", "first_id", "first_start", "n", "docs", "starts"])

    for batch in batches:
        for anchor, key, passage, doc, start in zip(*(c.to_pylist() for c in batch.columns)):
            if key == latest:  # sent by another task too
                held[-1] = (key, passage, *min(held[-1][2:], (doc, start)))
                continue
            if size >= INDEX_WORDS and anchor != last:
                yield index()
                held, size = [], 0
            held.append((key, passage, doc, start))
            size, last, latest = size + passage.count(b" ") + 1, anchor, key
    if held:
        yield index()


def _kept_rows(batches):
    for batch in batches:
        out = [[] for _ in range(3)]
        for t, cuts in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
            words = t.split()
            gone = np.zeros(len(words) + 1, np.int32)
            for c in cuts or ():
                start, mask = c["start"], c["mask"]
                if start < 0:  # a document of this text came before
                    gone[0] += 1
                    continue
                for k in range(SPAN):
                    if mask >> k & 1:
                        gone[start + k] += 1
                        gone[start + k + WINDOW] -= 1
            lost = np.cumsum(gone[:-1]) > 0
            if len(words) < WINDOW:
                lost[:] = False
            n = int(lost.sum())
            kept = b" ".join([w for w, x in zip(words, lost.tolist()) if not x] if n else words)
            for column, v in zip(out, (len(words), n, kept.decode())):
                column.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.large_string()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_removed, kept string: the kept words joined by spaces) per row.

    A null text has no words. Null doc_ids come before all others. Rows that repeat a doc_id with one text
    are one document, each answered alike; with other texts they are documents of equal rank, of which
    only the place of a window in its document tells which is earlier. An empty table gives an empty table.
    Other columns aren't looked at.
    """
    least = -(2**63)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), F.xxhash64(text).alias("short"), text.alias("text"))  # keys aren't null: both joins of rows share a shuffle
    found = cut(rows.mapInArrow(_anchor_rows, "id long, short long, anchors array<long>, agains array<boolean>"))
    each = found.select("id", "short", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("agains").alias("again"))).alias("a"))
    # anchors of one text only, once in it, are done, however many documents have that text
    other = F.when(F.col("a.again"), F.bitwise_not("short")).otherwise(F.col("short"))
    twice = each.groupBy(F.col("a.anchor").alias("anchor")).agg(F.min(F.least("short", other)).alias("low"), F.max(F.greatest("short", other)).alias("high")).where("low != high").select("anchor")
    bodies = rows.where(F.length("text") >= 2 * WINDOW - 1).select("id", "short", F.md5("text").alias("body"))
    same = bodies.groupBy("body").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("body", "first")
    later = cut(bodies.join(same, "body").where("id > first").select("id", "short").distinct())
    wanted = each.select("id", "short", F.col("a.anchor").alias("anchor")).join(twice, "anchor").groupBy("id", "short").agg(F.collect_list("anchor").alias("wanted"))
    wanted = cut(wanted.join(later, ["id", "short"], "left_anti"))
    searched = rows.join(wanted, ["id", "short"]).select("id", "short", "text", "wanted")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    combined = searched.mapInArrow(_combined_rows, "anchor long, key binary, id long, start long, passage binary")
    dealt = combined.repartition(shards, "anchor").sortWithinPartitions("anchor", "key").select("anchor", "key", "passage", "id", "start")
    places = dealt.mapInArrow(_shard_rows, "key binary, first_id long, first_start long, n int, docs array<long>, starts array<long>")
    met = searched.mapInArrow(_passage_rows, "id long, short long, start long, key binary").join(places, "key")

    def before(k: int):
        doc, start = F.coalesce(F.get("docs", F.lit(k)), "first_id"), F.coalesce(F.get("starts", F.lit(k)), F.col("first_start") + k)
        return (F.col("n") > k) & ((doc < F.col("id")) | ((doc == F.col("id")) & (start < F.col("start") + k)))

    mask = sum((F.when(before(k), 1 << k).otherwise(0) for k in range(1, SPAN)), F.when(before(0), 1).otherwise(0))
    all_of = later.select("id", "short", F.lit(-1).cast("long").alias("start"), F.lit(0).alias("mask"))
    cuts = met.select("id", "short", "start", mask.alias("mask")).where("mask > 0").distinct().unionByName(all_of).groupBy("id", "short").agg(F.collect_list(F.struct("start", "mask")).alias("cuts"))
    kept = rows.join(cuts, ["id", "short"], "left").select("id", "text", "cuts").mapInArrow(_kept_rows, "id long, n_words long, n_removed long, kept string")
    return kept.select(F.nullif("id", F.lit(least)).alias("doc_id"), "n_words", "n_removed", "kept")
