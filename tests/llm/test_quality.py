import zlib

import duckdb
import numpy as np

from roadweave.llm import quality
from roadweave.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, sf).collect()}
    marked = duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall()
    assert len(got) == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    out = [(got[d].predicted, q) for d, q in marked if got[d].held_out]
    right = {c: sum(p == q for p, q in out if q == c) / sum(q == c for _, q in out) for c in (0, 1)}
    print(right)
    assert right[1] > 0.97 and right[0] > 0.85


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x " * 50000, None)], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (9, 0), (2, None)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows) and rows[0].quality == "a"
    empty = docs.limit(0)
    assert quality.score(empty, quality.fit(empty, labels.limit(0))).collect() == []


def test_log_count_ratios_by_hand():
    rows = [np.array([0, 2]), np.array([2]), np.array([1, 2])]
    got = quality.log_count_ratios(rows, np.array([True, True, False]))
    p, q = np.ones(quality.SIZE), np.ones(quality.SIZE)
    p[[0, 2]] += [1, 2]
    q[[1, 2]] += 1
    assert np.allclose(got, np.log(p / p.sum()) - np.log(q / q.sum()))


def test_dual_optimum():
    """The descent reaches the optimum of the dual problem, as a plain projected gradient method finds it."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, rng.integers(1, 7), replace=False)) for _ in range(40)]
    good, ratio = rng.random(40) < 0.5, np.zeros(quality.SIZE)
    ratio[:12] = rng.normal(size=12)
    w, bias = quality.descend(rows, good, ratio, epochs=3000)
    x = np.zeros((40, 13))
    for v, r in zip(x, rows):
        v[r] = ratio[r] / np.sqrt(len(r))
    x[:, 12] = 1
    y = np.where(good, 1.0, -1.0)
    top = np.where(good, quality.COST[True], quality.COST[False])
    q = (x @ x.T) * np.outer(y, y)
    a, step = np.zeros(40), 1 / np.linalg.norm(q, 2)
    for _ in range(100_000):
        a = np.clip(a + step * (1 - q @ a), 0, top)
    best = (a * y) @ x
    assert np.allclose(w[:12], best[:12] * ratio[:12], atol=2e-3) and abs(bias - best[12]) < 2e-3
    # primal and dual values meet: no better solution exists
    primal = lambda v: v @ v / 2 + (top * np.maximum(0, 1 - y * (x @ v))).sum()
    dual = a.sum() - a @ q @ a / 2
    assert primal(np.append(w[:12] / np.where(ratio[:12] == 0, 1, ratio[:12]), bias)) < dual + 1e-2


def test_sample_bound(spark):
    docs = spark.createDataFrame([(1, "good words here")] * 50 + [(1, f"text {i}") for i in range(20)] + [(2, "zzz qqq")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, labels, sample=4)).count() == docs.count()
