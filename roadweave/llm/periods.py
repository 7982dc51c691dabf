"""Periodic runs of words, by the power-of-two names of Karp, Miller and Rosenberg.

Equal blocks of 2^k words of a document get equal names: names of level k + 1 are the ranks of pairs of names of level k,
up to the first level at which no two blocks are equal. How far two places agree, forwards or backwards, is read by
descending levels. A run of period q and length 4 q or more holds a place of the grid of step 2 q at which the block of
2^floor(log2 q) words equals the one q words on, so only such places are extended. No hashes and no suffix sorting.
A document is worked on alone; its arrays are as long as the document times the number of levels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST, TIMES = 6, 4  # a run has at least so many words, and so many periods
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def names(words: np.ndarray) -> list[np.ndarray]:
    """Level k names the blocks of 2^k words by their rank; the levels at which some block occurs twice."""
    levels, level = [], words
    while len(level):
        order = np.argsort(level, kind="stable")
        ranked = level[order]
        rank = np.zeros(len(level), np.int64)
        np.cumsum(ranked[1:] != ranked[:-1], out=rank[1:])
        if rank[-1] == len(level) - 1:
            break
        level = np.empty(len(level), np.int64)
        level[order] = rank
        levels.append(level)
        half = 1 << len(levels) - 1
        level = level[:-half] * (rank[-1] + 1) + level[half:]
    return levels


def agree(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from i (before i, if back) equal those from (before) j, i < j."""
    n, far = len(levels[0]), np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        size = 1 << k
        a, b = (i - far - size, j - far - size) if back else (i + far, j + far)
        fits = np.flatnonzero(a >= 0 if back else b + size <= n)
        same = levels[k][a[fits]] == levels[k][b[fits]]
        far[fits[same]] += size
    return far


def runs(words: np.ndarray) -> np.ndarray:
    """Numbered words -> rows (start, length, smallest period) of all maximal runs of max(LEAST, TIMES * period) words or
    more, by start, then period."""
    n, places, steps = len(words), [], []
    levels = names(words) if n >= LEAST else []
    for k, level in enumerate(levels):
        periods = np.arange(1 << k, min((2 << k) - 1, n // TIMES) + 1)
        if not len(periods):
            break
        many = (n - periods - (1 << k)) // (2 * periods) + 1
        q = np.repeat(periods, many)
        at = 2 * q * (np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many))
        hit = np.flatnonzero(level[at] == level[at + q])
        places.append(at[hit])
        steps.append(q[hit])
    if not sum(map(len, places)):
        return np.empty((0, 3), np.int64)
    at, q = np.concatenate(places), np.concatenate(steps)
    before = agree(levels, at, at + q, back=True)
    length = before + q + agree(levels, at, at + q)
    long_ = length >= np.maximum(LEAST, TIMES * q)
    start, length, q = (at - before)[long_], length[long_], q[long_]
    order = np.lexsort((q, length, start))
    rows = np.stack([start, length, q], 1)[order]
    if len(rows):  # a run is met at several places, and multiples of its period give the same stretch
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept(n: int, rows: np.ndarray) -> np.ndarray:
    """Which of n words stay: of each run only its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, rows[:, 0] + rows[:, 2], 1)
    np.add.at(depth, rows[:, 0] + rows[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def find(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """docs(doc_id, text, any others) -> (doc_id, n_words, runs array of (start, length, period), collapsed): the runs of
    each whole text's words (those between white space of ASCII), and the words left when each run keeps its first period,
    joined by one space. rewrite: changes the words of a document before.

    A null or empty text has no words and no runs. Every row is worked on alone, so repeated rows and ids give equal rows,
    null ids stay, and an empty table gives an empty one; other columns, whatever their names, aren't read. Of equal
    stretches with several periods the smallest counts. A very long text is one row of one task."""

    def work(batches):
        for batch in batches:
            found = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                words = (text or b"").split()
                if rewrite:
                    words = rewrite(doc, words)
                numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
                rows = runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                stay = words if not len(rows) else [words[i] for i in np.flatnonzero(kept(len(words), rows))]
                found.append((len(words), [dict(zip(("start", "length", "period"), r)) for r in rows.tolist()], b" ".join(stay).decode()))
            n, spans, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, pa.list_(RUN)), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
