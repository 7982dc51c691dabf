import random
import re
from collections import Counter

from pyspark.sql import functions as F

from roadweave.llm import decontamination


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs, items):
    """Over every window of every document, the pairs at 0.8 or more."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            want = shingles(v)
            if len(v) < 5 and w != v:
                continue
            for s in range(max(1, len(w) - len(v) + 1)) if v and w else ():
                have = shingles(w[s : s + len(v)])
                alike = sum((want & have).values()) / sum(want.values())
                if alike >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), alike)
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(a, b, 0, "x") for a, b in docs], "doc_id long, text string, item_id int, h string")
    b = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id): r.similarity for r in decontamination.leaks(d, b, **kw).collect()}


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([3, 5, 15, 30, 60]))) for i in range(30)]
    docs = [(0, None), (1, ""), (2, "  ...  ")]
    for d in range(3, 60):
        w, (_, item) = text(rng.choice([5, 80, 400])), rng.choice(items)
        at = rng.randrange(len(w))
        if d % 3 == 0:
            w[at:at] = item
        if d % 3 == 1:
            changed = list(item)
            changed[-1] = "Changed"
            w[at:at] = changed
        docs.append((d, " ".join(x.title() + rng.choice(["", ",", "%%%"]) for x in w)))
    docs += [docs[3], (99, " ".join(items[0][1]).upper())]
    return docs, [(i, " ".join(w)) for i, w in items] + [(90, None), (91, "")]


def test_against_all_windows(spark):
    docs, items = cases()
    want = brute(docs, items)
    assert len(want) > 20
    got = found(spark, docs, items)
    assert got == want
    assert found(spark, docs, items, broadcast_rows=0) == want


def test_empty_tables(spark):
    docs, items = cases()
    assert found(spark, [], items) == {} and found(spark, docs, []) == {}


def test_edited_items_just_over_the_threshold(spark):
    # 16 of 20 shingles stay, which leaves some windows more than 20 bits from their item
    rng = random.Random(13)
    items = [(i, [f"v{i}x{rng.randrange(10**6)}" for _ in range(24)]) for i in range(1200)]
    docs = [(i, " ".join(["before", *w[:20], "edited", *w[21:], "after"])) for i, w in items]
    got = found(spark, docs, [(i, " ".join(w)) for i, w in items])
    assert got == {(i, i): 0.8 for i, _ in items}


def edited(rng, w, share):
    """w with as many words changed as leave at least this share of its shingles."""
    v = list(w)
    while True:
        u = list(v)
        u[rng.randrange(len(u))] = f"new{rng.randrange(10**6)}"
        if len(set(shingles(u)) & set(shingles(w))) < share * len(shingles(w)):
            return v
        v = u


def test_recall_between_the_threshold_and_085(spark):
    rng = random.Random(17)
    template = "which of the following is the most likely answer to this question".split()
    items = [(i, template[: rng.choice([0, 12])] + [f"v{rng.randrange(3000)}" for _ in range(rng.choice([20, 40, 60]))]) for i in range(300)]
    docs = [(k, " ".join(["before"] * 3 + edited(rng, w, rng.uniform(0.8, 0.85)) + ["after"] * 3)) for k, (_, w) in enumerate(items)]
    texts = [(i, " ".join(w)) for i, w in items]
    want = {}
    for (d, t), item in zip(docs, texts):
        want |= brute([(d, t)], [item])
    got = found(spark, docs, texts)
    assert len(want) > 150 and got == want


def test_insertions_and_deletions(spark):
    """Words put in near the start and in the middle, or put in and left out at random: all that brute force finds."""
    rng = random.Random(23)
    new = lambda: f"new{rng.randrange(10**6)}"
    items = [(i, [f"v{i}x{rng.randrange(10**6)}" for _ in range(60)]) for i in range(60)]
    docs = []
    for i, w in items:
        at = rng.choice([3, 4, 5])
        docs.append((i, " ".join([new() for _ in range(rng.randrange(40))] + w[:at] + [new()] + w[at:30] + [new()] + w[30:] + [new() for _ in range(rng.randrange(40))])))
    for i, w in items:
        u = list(w)
        for _ in range(rng.choice([1, 2])):
            k = rng.randrange(len(u))
            u[k : k + (rng.random() < 0.5)] = [] if rng.random() < 0.5 else [new()]
        docs.append((100 + i, " ".join([new()] * rng.randrange(3) + u)))
    texts = [(i, " ".join(w)) for i, w in items]
    want = {}
    for d, t in docs:
        want |= brute([(d, t)], [texts[d % 100]])
    got = found(spark, docs, texts)
    assert sum(d < 100 for d, _ in want) == 60 and sum(d >= 100 for d, _ in want) > 50
    assert got == want
    starts = {(r.doc_id, r.item_id): (r.start, r.n_words) for r in decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string")).collect()}
    of = dict(docs)
    for (d, i), (start, n) in starts.items():
        have, item = shingles(words(of[d])[start : start + n]), shingles(items[i][1])
        assert sum((have & item).values()) / sum(item.values()) == want[d, i]


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        fp = rng.getrandbits(64)
        other = fp
        for b in rng.sample(range(64), decontamination.RADIUS):
            other ^= 1 << b
        rows.append((i, *(x - 2**64 if x >= 2**63 else x for x in (fp, other))))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    near = df.select("i", F.explode(decontamination.blocks(F.col("a"), True)).alias("block"))
    far = df.select("i", F.explode(decontamination.blocks(F.col("b"), False)).alias("block"))
    assert near.join(far, ["i", "block"]).select("i").distinct().count() == 400


def test_items_near_one_another_and_long_texts(spark):
    rng = random.Random(6)
    base = [f"b{k}" for k in range(40)]
    items = [(i, " ".join([*base[:i], f"only{i}", *base[i + 1 :]])) for i in range(0, 40, 5)]
    long = " ".join(f"x{rng.randrange(900)}" for _ in range(30_000))
    docs = [(1, long + " " + " ".join(base) + " " + long), (2, long), (3, " ".join(base))]
    assert found(spark, docs[2:], items) == brute(docs[2:], items)
    got = found(spark, docs, items)
    assert {i for d, i in got if d == 1} == {i for i, _ in items} and not any(d == 2 for d, _ in got)
