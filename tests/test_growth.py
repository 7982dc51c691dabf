"""Operators whose work must not grow with all pairs of a place, held against plain passes."""

import math
import random
import re

from pyspark.sql import functions as F

from roadweave import session
from roadweave.functions import lines as fold
from roadweave.operators import chains, conflation, graph, joins, layers, network, windows
from roadweave.plans import builds, layered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_files_are_not_broadcast(spark):
    a = spark.createDataFrame([(i, float(i), 0.0) for i in range(20)], "i int, x double, y double")
    met = joins.proximity_join(a, a.toDF("j", "u", "v"), ("x", "y"), ("u", "v"), 1.0)
    assert "Broadcast" not in plan(met) and met.count() == 58


def test_carriageways_are_not_broadcast(spark):
    assert "Broadcast" not in plan(layered.carriageway_pairs(spark, "/root/testdata/sf0.001"))


def test_tasks_follow_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 4000)
    monkeypatch.setattr(joins, "PIECE", 1000)
    rng = random.Random(7)
    # one cell holds most rows, and copies of one row
    a = [(i, "n", rng.randint(0, 9), rng.randint(0, 9)) for i in range(100)] + [(i, "m", rng.randint(-90, 90), rng.randint(-90, 90)) for i in range(100, 150)] + [(150, None, 1, 1), (151, "n", None, 1)]
    b = [(1000 + i, n, x, y) for i, n, x, y in a] + [(9, "n", 5, 5)] * 60
    left, right = spark.createDataFrame(a, "i int, name string, x long, y long"), spark.createDataFrame(b, "j int, name string, u long, v long")
    for on in ((), ("name",)):
        met = joins.proximity_join(left, right if on else right.drop("name"), ("x", "y"), ("u", "v"), 20.0, on=on)
        want = sorted((p[0], q[0]) for p in a for q in b if p[2] is not None and q[2] is not None and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 400 and (not on or p[1] is not None and p[1] == q[1]))
        assert sorted((r.i, r.j) for r in met.collect()) == want
        tasks = met.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 4 and max(r["count"] for r in tasks) <= 8000


def test_tasks_follow_the_rows_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(session, "SHARE", 100)
    many, few = spark.range(200).selectExpr("id i", "id * 10 x", "0 y"), spark.createDataFrame([(1, 5, 0)], "j int, u long, v long")
    for left, right, rows in ((many, few, 9 * 200), (few.toDF("i", "x", "y"), many.toDF("j", "u", "v"), 200)):
        met = joins.proximity_join(left, right, ("x", "y"), ("u", "v"), 5.0)
        assert met.count() == 2 and re.search(rf"hashpartitioning\(cell#\d+, {max(4, rows // 100)}\)", plan(met))


def test_nearest_on_sphere(spark):
    rng = random.Random(5)
    a = [(i, i % 3, rng.randint(0, 9000), rng.randint(-6000, 7500)) for i in range(120)]
    b = [(rng.randint(0, 2), rng.randint(0, 9000), rng.randint(-6000, 7500)) for _ in range(60)] + [(1, 0, 0), (1, 9000, 7500)]

    def metres(x, y, u, v):
        p, q = math.radians(y / 100), math.radians(v / 100)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians((u - x) / 100) / 2) ** 2
        return 2 * 6_371_008.8 * math.asin(math.sqrt(min(h, 1.0)))

    got = joins.nearest_on_sphere(spark.createDataFrame(a, "id int, area int, x long, y long"), spark.createDataFrame(b, "area int, u long, v long"), "id", ("x", "y"), ("u", "v"), 100.0, on=("area",))
    got = {r.id: r.metres for r in got.collect()}
    assert len(got) == len(a)
    for i, area, x, y in a:
        assert math.isclose(got[i], min(metres(x, y, u, v) for g, u, v in b if g == area), rel_tol=1e-9, abs_tol=1e-6)


def test_chains_without_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, f"n{i % 2}", rng.randint(0, 400), rng.randint(0, 400)) for i in range(160)] + [(200, "n0", 0, 0), (201, "n0", 0, 30), (202, "n0", 21, 51), (300, "n1", 900, 900)]
    links = layers.near_links(spark.createDataFrame(rows, "id long, name string, x long, y long"), 30.0).collect()
    root = {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def groups(pairs):
        root.update({r[0]: r[0] for r in rows})
        for u, v in pairs:
            a, b = sorted((top(u), top(v)))
            root[b] = a
        return {r[0]: top(r[0]) for r in rows}

    all_ = [(p[0], q[0]) for p in rows for q in rows if p[1] == q[1] and p[0] < q[0] and (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 900]
    assert groups(links) == groups(all_)
    # many in one place give a link each, not one for each pair
    dense = spark.range(3000).select("id", F.lit("n").alias("name"), (F.col("id") % 60).alias("x"), F.floor(F.col("id") / 60).alias("y"))
    assert layers.near_links(dense, 200.0).count() == 2999
    # and between the cells one each at most, whatever stands in them
    assert layers.cell_links(dense, 40.0)[1].count() <= 4 * 12


def test_smoothing_shuffles_no_pairs(spark):
    ways = spark.createDataFrame([(1, "s", 0, 0, 100, 10), (2, "s", 0, 0, 100, 10), (3, "s", 100, 0, 100, 90), (4, "s", 5000, 0, 100, 90), (5, None, 0, 0, 100, 90)], "way long, street string, x long, y long, length long, aadt long")
    got = fold.smooth_counts(ways)
    assert [tuple(r) for r in got.collect()] == [(3, 90, 10, 3, 300)]
    assert "Join" not in plan(got)


def test_builds_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "SHARE", 1000)
    got = builds.unpaired_rows(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert re.search(rf"hashpartitioning\(way#\d+L?, ordinal#\d+, {-(-rows // 1000)}\)", plan(got)) and rows > 4000


def test_spots_shuffle_no_pairs_with_lines(spark):
    rows = [(1, 1, 3, 0, 0), (1, 2, 3, 50, 0), (1, 3, 3, 90, 0), (2, 1, 2, 50, 5), (2, 2, 2, 50, 80), (3, 1, 4, 90, 1), (3, 2, 4, 91, 1), (3, 3, 4, 95, 0), (3, 4, 4, 300, 0), (4, 1, 1, None, 0)]
    lines = spark.createDataFrame(rows, "line int, at int, last int, x long, y long").withColumn("first", F.lit(1))
    spots = spark.createDataFrame([(1, 0, 0), (2, 50, 2), (3, 90, 0), (4, 50, 80), (5, 700, 0)], "spot int, sx long, sy long")
    got = layers.all_end(lines, spots, 10.0)
    # at spot 3 line 3 has two vertices between its ends, but begins there too
    assert {r.spot: r.all_end for r in got.collect()} == {1: True, 2: False, 3: True, 4: True}
    assert not re.search(r"hashpartitioning\(spot#\d+L?, line", plan(got))


def test_keys_of_many_rows_stay_where_they_are(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 7 if i < 40 else i % 5 if i < 60 else None) for i in range(63)], "i int, k int")
    one = spark.createDataFrame([(7, "seven"), (1, "one"), (3, "three"), (9, "nine")], "k int, name string")
    got = graph.hub_join(rows, one, "k", 20)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(one, "k", "left").select(*got.columns).collect()))
    links = spark.range(1, 500).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    assert graph.components(links).where("component = 0").count() == 500
    monkeypatch.setattr(session, "SHARE", 40)
    assert graph.components(links).where("component = 0").count() == 500
    inner = spark.createDataFrame([(1, 10, None), (2, 10, "gate"), (2, 11, None), (3, 30, None), (4, None, "gate"), (5, 11, None)], "way long, node long, reason string")
    found = conflation.through_networks(inner, spark.createDataFrame([(10,), (10,), (11,), (30,)], "node long"))
    assert [tuple(r) for r in found.collect()] == [(1, 3, 2)] and "Expand" not in plan(found)


def test_claims_carry_numbers_not_ranks(spark, monkeypatch):
    import pandas as pd

    rng, kept = random.Random(8), []
    monkeypatch.setattr(conflation, "cut", lambda df: kept.append(df.columns) or session.cut(df))
    rows = [(i // 3, rng.randrange(4), rng.randrange(2), rng.choice([0.5, 1.0]), *(a := rng.uniform(0, 100), a + 12.0), 1.0) for i in range(60)] + [(50, 1, 0, 0.9, None, None, 1.0)]
    names = ["way", "feature", "precedence", "share", "lo", "hi", "apart"]
    rows = list({r[:2]: r for r in rows}.values())
    want = conflation.greedy_claims(pd.DataFrame(rows, columns=names))
    got = conflation.claim(spark.createDataFrame(rows, "way long, feature long, precedence int, share double, lo double, hi double, apart double"), 3)
    assert sorted((r.way, r.feature) for r in got.collect()) == sorted(zip(want["way"], want["feature"]))
    assert len(kept) > 2 and not any("rank" in c or "cells" in c for c in kept)


def test_claims_in_slices(spark, monkeypatch):
    import pandas as pd

    rng, counts, nan = random.Random(11), [], float("nan")
    names, kinds = ["way", "feature", "precedence", "share", "lo", "hi", "apart"], "way long, feature long, precedence int, share double, lo double, hi double, apart double"
    monkeypatch.setattr(conflation, "cut", lambda df: (out := session.cut(df), counts.append(out.count()))[0])
    rows = {}
    for _ in range(1200):
        # short and long stretches, points, ends the wrong way round, no ends, no share
        w, f, lo = rng.randrange(400), rng.randrange(6), rng.choice([rng.uniform(0, 300), float(rng.randrange(0, 300, 20))])
        lo, hi = rng.choice([(lo, lo + 20.0)] * 30 + [(lo, lo + 150.0), (lo, lo), (lo + 9.0, lo), (lo, lo + 0.1)])
        lo, hi = rng.choice([(lo, hi)] * 60 + [(None, hi), (lo, nan), (nan, None)])
        rows[w, f] = (w, f, rng.choice([0, 1, 2, None]), rng.choice([0.5, 0.7, 1.0, None]), lo, hi, rng.choice([rng.uniform(0, 9), nan]))
    rows = list(rows.values())
    plain = lambda found: sorted(tuple(None if x != x else x for x in r) for r in found.to_numpy(dtype=float).tolist())
    want = plain(conflation.greedy_claims(pd.DataFrame(rows, columns=names)))
    df = spark.createDataFrame(rows, kinds)
    for finish, share in ((30, 64), (5000, 1)):
        monkeypatch.setattr(conflation, "SOME", share * len(rows))
        got = conflation.claim(df, finish, whole=len(rows) // 64 if share > 1 else len(rows))
        assert [tuple(map(str, r)) for r in plain(got.toPandas())] == [tuple(map(str, r)) for r in want]
    monkeypatch.setattr(session, "SHARE", 200)
    counts.clear()
    dense = [(i, i % 5, i % 7, 0.5, float(i * 37 % 1000), float(i * 37 % 1000 + 90), 0.0) for i in range(3000)]
    got = conflation.claim(spark.createDataFrame(dense, kinds), 20, whole=1000)
    assert sorted(r.way for r in got.collect()) == sorted(conflation.greedy_claims(pd.DataFrame(dense, columns=names))["way"])
    # all that rounds write and read again is less than the rows; most are only looked up once
    assert sum(counts) < len(dense)


def test_chains_of_rings_and_spurs_are_followed_once(spark, monkeypatch):
    counts, calls, whole = [], [], chains.chains

    def told(lines, pairs):
        calls.append(lines.count())
        return whole(lines, pairs)

    monkeypatch.setattr(chains, "chains", told)
    monkeypatch.setattr(network, "chains", told)
    ways = [("A", "outer", 1, 1, 2), ("A", "outer", 2, 3, 2), ("A", "outer", 3, 3, 1), ("B", "outer", 4, 1, 2), ("B", "outer", 5, 2, 3)]
    rings, left = chains.closed_rings(spark.createDataFrame(ways, "area string, role string, way long, a long, b long"))
    assert calls == [5] and {r.way for r in rings.collect()} == {1, 2, 3} and {r.way for r in left.collect()} == {4, 5}
    calls.clear()
    # a square, on it a stem of 10 edges that forks into two tips of 10: the tips go, then the stem with what is now its end is long
    edges = [(i, i, (i + 1) % 4, 9.0) for i in range(4)] + [(4, 0, 2, 9.0)] + [(100 + i, 0 if not i else 99 + i, 100 + i, 1.0) for i in range(10)]
    edges += [(b + i, 109 if not i else b - 1 + i, b + i, 1.0) for b in (200, 300) for i in range(10)]
    gone = network.spurs(spark.createDataFrame(edges, "row long, u long, v long, cost double"), 15.0)
    assert {r.row for r in gone.collect()} == set(range(100, 110)) | set(range(200, 210)) | set(range(300, 310))
    assert calls[0] == len(edges) and max(calls[1:]) <= 6
    # states at their head aren't jumped again
    monkeypatch.setattr(chains, "cut", lambda df: counts.append(df.count()) or session.cut(df))
    pairs = [(i, 1, i + 1, 0) for i in range(0, 9)] + [(i + 1, 0, i, 1) for i in range(0, 9)]
    got = whole(spark.range(30).toDF("line"), spark.createDataFrame(pairs, "line long, side int, other long, other_side int"))
    assert {r.line: (r.chain, r.place) for r in got.collect()} == {i: (0, i) if i < 10 else (i, 0) for i in range(30)}
    assert counts[0] == 60 and counts[1] == 18 and counts[-1] < 18


def test_following_by_stretches(spark):
    rng = random.Random(2)
    rows = [(g, k) for g in range(3) for k in rng.sample(range(200), 25)] + [(4, 5)]
    got = windows.following(spark.createDataFrame(rows, "road int, line long"), "road", "line", "other", 7)
    want = {(g, k): min((m for h, m in rows if h == g and m > k), default=None) for g, k in rows}
    assert {(r.road, r.line): r.other for r in got.collect()} == want and not re.search(r"hashpartitioning\(road#\d+, \d+\).{0,200}FileScan", plan(got))
