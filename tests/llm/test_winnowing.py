import hashlib
import random
import re

from pyspark.sql import functions as F

from roadweave.llm import winnowing


def found(spark, rows, parts=5):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, key string, guest int")
    return winnowing.fingerprints(df, parts).withColumn("fp", winnowing.as_text(F.col("choices"))).collect()


def brute_choices(spark, text):
    t = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    grams = [t[i : i + 5] for i in range(len(t) - 4)] or ([[" ".join(t)]] if t else [])
    h = [spark.createDataFrame([(g,)], "g array<string>").select(F.xxhash64(*[F.get("g", F.lit(j)) for j in range(len(g))])).first()[0] % 2**32 for g in grams]
    out = []
    for i in range(max(1, len(h) - 7) if h else 0):
        w = h[i : i + 8]
        at = max(j for j in range(len(w)) if w[j] == min(w)) + i
        if (h[at], at) not in out:
            out.append((h[at], at))
    return " ".join(f"{x:x}:{p}" for x, p in out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i * 7, " ".join(rng.choice(["a", "bb", "cé", "d" * 40, "\n"]) for _ in range(rng.choice([0, 1, 4, 5, 9, 12, 13, 30, 200])))) for i in range(60)]
    rows += [(1000, None), (1001, ""), (None, "first of all"), (14, rows[2][1]), (1002, "x" * 50000)]
    got = sorted(found(spark, rows), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.doc_id, r.text) for r in got] == order
    for i, r in enumerate(got):
        nxt, n = order[(i + 1) % len(order)][1], len(r.text)
        edited = r.text[: n - n // 4] + nxt[: n // 4]
        assert (r.n_chars, r.edited) == (n, edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r in got[:12]:
        assert r.fp == brute_choices(spark, r.text)


def test_small_tables(spark):
    assert found(spark, []) == []
    (r,) = found(spark, [(5, "a b c d e f g h")])
    assert r.edited == "a b c d e f a b" and r.near_next == 1.0
    a, b = sorted(found(spark, [(1, "same text"), (2, "same text")]), key=lambda r: r.doc_id)
    assert a.fp == b.fp and a.near_next == 1.0 and hashlib.sha256(a.edited.encode()).hexdigest()
