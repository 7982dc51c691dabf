import random

import numpy as np

from roadweave.llm import fmindex, substrings
from roadweave.session import table


def brute(rows):
    first = {}
    split = [(d if d is not None else -(2**63), (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (d, s)), (d, s))
    out = []
    for (d, _), (i, w) in zip(rows, split):
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone.update(range(s, s + 20))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def answer(spark, rows):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, start int, passage string")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(df).collect()), key=str)


def test_search_against_counting():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 9, 4000), 0)
    index = fmindex.FMIndex(text, 4)
    patterns = np.stack([text[i : i + 4] for i in range(0, 3000, 7)])
    low, high = index.search(patterns)
    for p, a, b in zip(patterns, low, high):
        hits = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(x for x in index.suffixes[a:b] if x < len(text) - 3) == hits


def cases():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(80)] + ["É", "日本", "x\x1cy"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    shared = [text(rng.choice([15, 20, 21, 40, 90])) for _ in range(8)]
    rows = []
    for d in range(60):
        w = text(rng.choice([0, 5, 30, 120]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(shared)
        rows.append((rng.randrange(1000) * 2, " ".join(w)))
    whole = [d for d in rows if d[1].count(" ") > 60]
    rows += [(5000 + i, whole[0][1].replace(" ", "\n")) for i in range(30)] + [(1, "la " * 300), (3, "la " * 25 + "end"), (7, "a b " * 40), (9, None), (11, ""), (None, whole[1][1]), whole[2], whole[2]]
    return list(rows)


def test_against_brute_force(spark, monkeypatch):
    rows = cases()
    ids = [d for d, _ in rows]
    rows = [r for i, r in enumerate(rows) if r[0] not in ids[:i] or r == rows[ids.index(r[0])]]
    assert answer(spark, rows) == brute(rows)


def test_many_small_indexes():
    rows = [(i, " ".join(random.Random(i % 5).choices("abcdefgh", k=60))) for i in range(20)]
    texts = [t.encode() for _, t in rows]
    docs, starts = substrings.earliest(texts, np.array([d for d, _ in rows]), np.zeros(20, np.int64))
    for i in range(20):
        assert len(docs[i]) == 41 and (docs[i] == i % 5).all() and (starts[i] == np.arange(41)).all()


def test_documents(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert answer(spark, []) == []
