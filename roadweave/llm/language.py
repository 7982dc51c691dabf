"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's n-grams are the 1-, 2- and 3-byte ones of its letters in lower case (UTF-8), with one space for all between
words, in 2^BITS numbered buckets. Their counts, damped by a logarithm, times the inverse document frequency over all
learned documents, have length 1. Each language has up to CLUSTERS centroids (spherical k-means), and a text goes to the
language of the centroid of the greatest cosine. A text is distant where that cosine is well below what nearly all
fitted texts of the centroid reach.

Document frequencies are those of all learned rows. Centroids are fitted on at most SAMPLE rows of a language, those of
the smallest hashes, a task a language; a model has at most MOST languages, so that what is broadcast is bounded.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 15
SIZE = 1 << BITS
SAMPLE = 500
CLUSTERS = 6
ROUNDS = 12
MOST = 256
NEARLY_ALL, SLACK = 0.005, 0.05  # a text is distant by this much below the cosine that all but this share of the fitted texts reach
UNKNOWN = "und"
BETWEEN = re.compile(r"[\W\d_]+")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram buckets of a text and their counts."""
    a = np.frombuffer(f" {BETWEEN.sub(' ', text.lower()).strip()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    spread = lambda code: (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    code = np.concatenate([a, spread(a[:-1] << 8 | a[1:] | 1 << 24), spread(a[:-2] << 16 | a[1:-1] << 8 | a[2:])])
    counts = np.bincount(code, minlength=SIZE)
    ids = np.flatnonzero(counts)
    return ids, counts[ids]


def weigh(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of length 1."""
    w = (np.log1p(counts) * idf[ids]).astype(np.float32)
    return w / max(float(np.sqrt(w @ w)), 1e-12)


def frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and of rows with each bucket, over all of docs(text). A task sends its sums only, and what
    reaches the driver is a number for each bucket."""

    def sums(batches):
        total, seen = 0, np.zeros(SIZE, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[buckets(text)[0]] += 1
                total += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(seen[used], total))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(SIZE + 1, np.int64)
    for r in rows:
        n[r["bucket"]] = r["n"]
    return int(n[-1]), n[:SIZE]


def cluster(x: np.ndarray, most: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of rows of length 1, begun at the row nearest the mean and then at the rows farthest from those
    begun with: (centroids of length 1, the nearest one of each row)."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    begun = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[begun[0]]
    while len(begun) < most and near.min() < 1 - 1e-6:
        begun.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[begun[-1]])
    centres, own = x[begun], None
    for _ in range(rounds):
        now = np.argmax(x @ centres.T, 1)
        if own is not None and (now == own).all():
            break
        own = now
        centres = np.stack([unit(x[own == k].mean(0)) if (own == k).any() else c for k, c in enumerate(centres)])
    return centres, np.argmax(x @ centres.T, 1)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """docs(doc_id, text, lang), the rows to learn from -> model. Rows with a null lang, or a text that is null or has no
    letter, aren't used; equal rows count once among the sample. Without any usable row the model has no language."""
    usable = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    total, seen = frequencies(usable)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)
    shares = usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * sample) / F.count("*")).alias("share"))
    # of a frequent language only the rows of small hashes are sorted
    drawn = usable.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(shares.limit(MOST + 1)), "lang")
    drawn = drawn.where((F.col("h") / F.lit(2.0**64) + 0.5) < F.col("share")).dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    drawn = drawn.select("lang", "h").withColumn("place", place).where(F.col("place") <= sample).drop("place").join(drawn.select("lang", "h", "text"), ["lang", "h"])

    def vectors(batches):
        for batch in batches:
            found = [buckets(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary()), pa.array([weigh(i, c, idf).tobytes() for i, c in found], pa.binary())], names=["lang", "h", "ids", "weights"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        x = np.zeros((len(pdf), SIZE), np.float32)
        for row, i, w in zip(x, pdf["ids"], pdf["weights"]):
            row[np.frombuffer(i, np.int32)] = np.frombuffer(w, np.float32)
        centres, own = cluster(x)
        cosines = np.einsum("ij,ij->i", x, centres[own])
        least = [float(np.quantile(cosines[own == k], NEARLY_ALL)) - SLACK if (own == k).any() else 1.0 for k in range(len(centres))]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]] * len(centres), "cluster": range(len(centres)), "centre": [c.astype(np.float32).tobytes() for c in centres], "least": least})

    sent = drawn.select("lang", "h", "text").mapInArrow(vectors, "lang string, h long, ids binary, weights binary")
    rows = sorted(sent.groupBy("lang").applyInPandas(learn, "lang string, cluster int, centre binary, least double").collect(), key=lambda r: (r["lang"], r["cluster"]))
    if len({r["lang"] for r in rows}) > MOST:
        raise ValueError(f"more than {MOST} languages")
    centres = np.stack([np.frombuffer(r["centre"], np.float32) for r in rows], 1) if rows else np.zeros((SIZE, 0), np.float32)
    return {"idf": idf, "langs": [r["lang"] for r in rows], "least": [r["least"] for r in rows], "centres": np.ascontiguousarray(centres)}


def nearest(text: str, model: dict) -> tuple[str, float, bool]:
    """Language, cosine and distance flag of a text with a letter; ties go to the first language by code point."""
    ids, counts = buckets(text)
    cosines = weigh(ids, counts, model["idf"]) @ model["centres"][ids]
    k = int(np.argmax(cosines))
    return model["langs"][k], min(max(float(cosines[k]), 0.0), 1.0), float(cosines[k]) < model["least"][k]


def identify(docs: DataFrame, model: dict, reject: bool = False) -> DataFrame:
    """docs with lang_pred, score (the cosine, 0 to 1) and distant; other columns stay, but for any of these names, which
    are replaced. With reject, distant texts get UNKNOWN.

    A text that is null or has no letter is UNKNOWN with score 0 and not distant, and so is every text under a model
    without languages. Every whole text is judged alone, whatever its length, so repeated rows get equal answers; an
    empty table gives an empty table."""
    new = ["lang_pred", "score", "distant"]
    kept = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            found = []
            texts, lettered = batch.column(batch.schema.get_field_index("text")), batch.column(batch.num_columns - 1).to_pylist()
            for text, letter in zip(texts.to_pylist(), lettered):
                lang, score, distant = nearest(text, model) if letter and model["langs"] else (UNKNOWN, 0.0, False)
                found.append((UNKNOWN if reject and distant else lang, score, distant))
            lang, score, distant = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(distant, pa.bool_())], names=[*batch.schema.names[:-1], *new])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)
    return docs.select(*kept, has_letter(F.col("text")).alias("__lettered")).mapInArrow(work, f"{fields}, lang_pred string, score double, distant boolean")
