import random

import xxhash

from roadweave.llm import simhash


def brute(rows):
    def fp(text):
        w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << i for i in range(64) if sum(x >> i & 1 for x in h) * 2 > len(h))

    fps = [(d, fp(t)) for d, t in rows]
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, f"{f:016x}", least[root(i)]) for i, (d, f) in enumerate(fps))


def answer(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component string")
    return sorted((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in simhash.near_duplicates(df).collect())


def test_matches_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}é" for i in range(50)] + ["Alpha", "BETA"]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 300, 900]))] for _ in range(25)]
    rows = [(0, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "ONE"), (7, "\x1cone")]
    for b in base:
        for _ in range(4):
            v = list(b)
            if rng.random() < 0.7:
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append((10 + len(rows) * 3, "\n".join(v)))
    rows.append(rows[-1])
    assert answer(spark, rows) == brute(rows)


def test_large_group_by_common_neighbours(spark):
    # more than SMALL fingerprints under one key
    fps = [(i, simhash.signed(i ^ (i << 1) & 0xFF)) for i in range(200)]
    df = spark.createDataFrame(fps, "node long, fp long")
    from roadweave.operators.graph import components

    got = {r.node: r.component for r in components(simhash.links(df)).collect()}
    parent = {n: n for n, _ in fps}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in fps:
        for m, b in fps:
            if n < m and ((a ^ b) % 2**64).bit_count() <= 2:
                x, y = sorted((root(n), root(m)))
                parent[y] = x
    assert {n: got.get(n, n) for n, _ in fps} == {n: root(n) for n, _ in fps}


def test_empty(spark):
    assert answer(spark, []) == []


def test_near_copies_with_a_passage_shared_by_hundreds(spark):
    # more than SMALL texts under most sketch keys: 75 to 88% of the shingles are one passage, and each text has a near copy
    rng = random.Random(11)
    passage, rows = [f"p{i}" for i in range(100)], []
    for k in range(250):
        own = [f"o{k}x{i}" for i in range(rng.randrange(14, 34))]
        at = rng.randrange(len(own) + 1)
        words = own[:at] + passage + own[at:]
        copy = words[:-1] + [f"c{k}"]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(copy))]
    rows += [(5000 + k, " ".join(f"z{k}x{i}" for i in range(60))) for k in range(40)]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    parent = {d: d for d in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: root(d) for d in sets} and len(set(got.values())) > 200
