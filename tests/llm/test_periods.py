import hashlib
import random
import zlib

import duckdb
import numpy as np

from roadweave.llm import periods
from roadweave.llm.queries import QUERIES


def plain_runs(words):
    """All maximal runs by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def told(doc_id, text):
    """What op13 says of a document, from its definition."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p, old = 1 + (n - a) // (3 + g % 8), list(words)
        for i in range(a, n):
            words[i] = old[a + (i - a) % p]
    rows = plain_runs(words)
    dropped = {i for s, length, q in rows for i in range(s + q, s + length)}
    best = max(rows, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    hexed = lambda b: hashlib.sha256(b).hexdigest()
    lines, stay = "".join(f"{s},{length},{q}\n" for s, length, q in rows).encode(), b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(rows), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hexed(lines), hexed(stay))


def test_runs_against_every_place():
    rng = random.Random(5)
    for _ in range(1500):
        n, letters = rng.randrange(60), rng.choice([1, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.6 and n > 8:  # nested repeats, one changed place
            unit = words[: rng.randrange(1, 6)] * rng.randrange(2, 5) + [9] * rng.randrange(2)
            words = words[:5] + unit * rng.randrange(2, 6) + words[5:]
            words[rng.randrange(len(words))] = rng.randrange(letters + 1)
        assert [tuple(r) for r in periods.runs(np.array(words, np.int64)).tolist()] == plain_runs(words), words


def test_names_are_names():
    rng = np.random.default_rng(2)
    words = np.concatenate([rng.integers(0, 3, 50), np.tile([1, 2, 0, 2], 20)])
    for k, level in enumerate(periods.names(words)):
        blocks = [tuple(words[i : i + 2**k]) for i in range(len(words) - 2**k + 1)]
        assert len(level) == len(blocks) and len({*level.tolist()}) == len({*blocks}) == len({*zip(level.tolist(), blocks)})


def test_query_against_definition(spark):
    sf = "/root/testdata/sf0.001"
    want = {told(*r) for r in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, sf).collect()]
    assert len(got) == len(want) and {*got} == want
    assert sum(r[1] > 0 for r in got) > 15


def test_odd_rows(spark, tmp_path):
    long_ = "a b " * 100_000 + "c " * 7 + "d e d e"
    rows = [(None, "x x x x x x x"), (1, None), (2, ""), (2, ""), (3, " \t\n"), (4, "y y y y y"), (4, "z z z z z z"), (5, long_)]
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, text string, runs string, period int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    small = [r for r in rows if r[1] != long_]
    assert [g for g in got if g[0] != 5] == sorted((told(*r) for r in small), key=str)
    big = next(r for r in periods.find(docs).collect() if r.doc_id == 5)
    assert [tuple(r) for r in big.runs] == [(0, 200_000, 2), (200_000, 7, 1)] and big.collapsed == "a b c d e d e"
    assert periods.find(docs.limit(0)).collect() == []
