"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

N-grams are those of bytes, not of words: features of a text are the presence of its
byte 1-, 2- and 3-grams (lower-cased, white space kept), and of patterns of its words:
how large a share repeats the word before, and how large a share is new, by the
text's length. Each
indicator is scaled by its class log-count ratio and by the text's number of
features; a linear hinge-loss model is fitted to these by dual coordinate descent;
a logistic curve through margins of rows kept aside turns margins into scores.

The model is fitted on at most SAMPLE labelled rows, those of the smallest hash of
id and text, in one task; its size doesn't depend on the corpus. Scoring reads whole
texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000
BITS = 17
PATTERNS = 1024
SIZE = PATTERNS + 256 + 65536 + (1 << BITS)
EPOCHS = 12
COST = {True: 1.0, False: 3.0}
THRESHOLD = 0.3


def _share(part: int, whole: int) -> int:
    """Ten steps, finer near none."""
    return 0 if not part else min(9, 1 + int(9 * math.sqrt(part / whole)))


def features(text: bytes) -> np.ndarray:
    """Sorted distinct feature numbers; an empty text has its patterns only."""
    text = text.lower()
    words = text.split()
    n, length = len(words), min(9, len(words).bit_length())
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = text.split(b"\n")
    found = [10 * length + _share(again, n or 1), 100 + 10 * length + _share(len(set(words)), n or 1), 200 + 10 * length + _share(len(lines) - len(set(lines)), len(lines)), 300 + length]
    a = np.frombuffer(text, np.uint8).astype(np.uint32)
    out = [np.array(sorted(found), np.uint32), np.unique(a) + PATTERNS]
    if len(a) > 1:
        seen = np.unique(a[:-1] << 8 | a[1:])
        out.append(seen + np.uint32(PATTERNS + 256))
    if len(a) > 2:
        seen = np.unique(a[:-2] << 16 | a[1:-1] << 8 | a[2:])
        out.append(np.unique(seen * np.uint32(2654435761) >> np.uint32(32 - BITS)) + np.uint32(PATTERNS + 256 + 65536))
    return np.concatenate(out).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    counts = {side: np.ones(SIZE) for side in (True, False)}
    for f, g in zip(rows, good):
        counts[bool(g)][f] += 1
    return np.log((counts[True] / counts[True].sum()) / (counts[False] / counts[False].sum()))


def descend(rows, good, ratio, epochs: int = EPOCHS, cost=COST, seed: int = 1):
    """Dual coordinate descent for the hinge loss: weights (already times ratio) and bias."""
    shrink = [1 / math.sqrt(len(f)) for f in rows]  # a row's features are ratio[f] * shrink, not kept: they'd take more room than the texts
    y = np.where(good, 1.0, -1.0)
    top = np.where(good, cost[True], cost[False])
    square = np.array([(ratio[f] @ ratio[f]) * c * c + 1 for f, c in zip(rows, shrink)])
    w, bias, alpha, order = np.zeros(SIZE), 0.0, np.zeros(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f = rows[i]
            x = ratio[f] * shrink[i]
            gradient = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), top[i])
            if step := (new - alpha[i]) * y[i]:
                w[f] += step * x
                bias += step
                alpha[i] = new
    return w * ratio, bias


def margin(f: np.ndarray, w: np.ndarray, bias: float) -> float:
    return float(w[f].sum() / math.sqrt(len(f)) + bias)


def curve(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), by Newton steps on smoothed targets."""
    up, down = good.sum(), (~good).sum()
    t = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    x, k = np.stack([margins, np.ones_like(margins)]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(k @ x, -30, 30)))
        h = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        k = k - np.clip(np.linalg.solve(h, x @ (p - t) + 1e-3 * (k - [1, 0])), -2, 2)
    return float(k[0]), float(k[1])


def train(rows: list[np.ndarray], good: np.ndarray):
    """Features and labels -> (weights float32, bias, a, b); without both classes the score is a constant."""
    if good.all() or not good.any():
        share = (good.sum() + 1) / (len(good) + 2)
        return np.zeros(SIZE, np.float32), 0.0, 0.0, math.log(share / (1 - share))
    aside = np.arange(len(rows)) % 4 == 3
    if len({*good[aside]}) < 2 or len({*good[~aside]}) < 2:
        aside[:] = False
    fit = np.flatnonzero(~aside)
    ratio = log_count_ratios([rows[i] for i in fit], good[fit])
    w, bias = descend([rows[i] for i in fit], good[fit], ratio)
    check = np.flatnonzero(aside) if aside.any() else fit
    a, b = curve(np.array([margin(rows[i], w, bias) for i in check]), good[check])
    return w.astype(np.float32), bias, a, b


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple:
    """docs(doc_id, text), labels(doc_id, quality 0/1) -> model, from at most sample rows of docs. Rows with null
    ids or labels aren't used; equal rows count once; without any usable row every score is 0.5. Texts are used
    whole, however long; null ones are empty. Either table may be empty."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).dropna()
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # ids may repeat: again at most sample rows
    rows = rows.select("doc_id", "text", "good").distinct().orderBy(F.xxhash64("doc_id", "text"), "doc_id", "good").limit(sample)

    def learn(batches):
        found = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), b.column(2).to_pylist())]
        found.sort(key=lambda r: (r[0] * 2654435761 % 2**32, r[1] or b""))  # the same rows in the same order, however they arrive
        rows, good = [features(t or b"") for _, t, _ in found], np.array([g for _, _, g in found], bool)
        found.clear()
        w, bias, a, b = train(rows, good)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())] + [pa.array([float(x)]) for x in (bias, a, b)], names=["w", "bias", "a", "b"])

    m = rows.repartition(1).mapInArrow(learn, "w binary, bias double, a double, b double").first()
    return (m["w"], m["bias"], m["a"], m["b"]) if m else (np.zeros(SIZE, np.float32).tobytes(), 0.0, 0.0, 0.0)


def score(docs: DataFrame, model: tuple, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 by its whole text (null: empty); other columns stay, but for one called column,
    which the score replaces. Every row is scored alone, whatever its length: repeated rows get equal scores, an
    empty table gives an empty table."""
    kept = [c for c in docs.columns if c != column]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w, bias, a, b = shared.value
        w = np.frombuffer(w, np.float32)
        for batch in batches:
            scores = []
            for t in batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist():
                x = a * margin(features(t or b""), w, bias) + b
                scores.append(1 / (1 + math.exp(-min(max(x, -60), 60))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)
    return docs.select(*kept).mapInArrow(run, f"{fields}, {column} double")
