import random

from roadweave.operators import layers


def test_chains_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(3000), rng.randrange(3000), rng.randrange(1, 9)) for i in range(300)]
    rows += [(300 + i, "a", 50, 50, 1) for i in range(5)]
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for p in rows:
        for q in rows:
            if p[0] < q[0] and p[1] and p[1] == q[1] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 400**2:
                a, b = sorted((root(p[0]), root(q[0])))
                parent[b] = a
    length = {}
    for r in rows:
        length[root(r[0])] = length.get(root(r[0]), 0) + r[4]
    df = spark.createDataFrame(rows, "id long, name string, x long, y long, length long")
    want = sorted((r[0], root(r[0]), length[root(r[0])]) for r in rows if r[1])
    assert sorted(map(tuple, layers.chains(df, 400.0).collect())) == want
    assert layers.chains(df.limit(0), 400.0).collect() == []


def test_numbers_have_no_holes(spark):
    rows = [(random.Random(i).randrange(40), "xyz"[i % 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b string")
    got = {(r.a, r.b): r.number for r in layers.dense_numbers(df, ["a", "b"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(set(rows)), 1)}
    assert layers.dense_numbers(df.limit(0), ["a", "b"]).collect() == []
