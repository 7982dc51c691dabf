"""Readers of tags, one case after another, and operators that had no case of their own."""

import random
import time

import pytest
from pyspark.sql import functions as F

from roadweave.functions import tags as read
from roadweave.operators import graph, joins


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Constitution Ave., NW", "Constitution Avenue Northwest", True),
        ("Constitution Ave NW", "Constitution Avenue", True),
        ("Constitution Ave NW", "Constitution Ave SE", False),
        ("E St NW", "E Street Northwest", True),
        ("E St", "East Street", False),
        ("St Johns Rd", "Saint Johns Road", True),
        ("Main St", "Main Saint", False),
        ("Fort & Main Rd", "fort and main road", True),
        ("N Capitol St", "North Capitol Street", True),
        ("St", "Street", True),
        ("A Street", "B Street", False),
    ],
)
def test_street_names(spark, a, b, same):
    assert spark.range(1).select(read.names_match(F.lit(a), F.lit(b))).first()[0] is same


@pytest.mark.parametrize(
    "tags, lanes",
    [
        ({"lanes": "2;3", "oneway": "yes"}, 3),
        ({"lanes": "5"}, 2),
        ({"lanes": "x"}, None),
        ({"lanes:forward": "3", "turn:lanes:forward": "left|through"}, 3),
        ({"lanes:forward": "3", "turn:lanes:forward": "left|through|right"}, 1),
        ({"lanes:forward": "2", "turn:lanes:forward": "left|through;right"}, 1),
        ({"lanes:forward": "2", "turn:lanes:forward": "|none"}, 2),
        ({"lanes:forward": "2", "turn:lanes:forward": "left|right"}, 1),
        ({"lanes": "4", "lanes:forward": "1"}, 3),
        ({"lanes": "5", "lanes:forward": "2", "lanes:both_ways": "1"}, 2),
        ({"lanes": "4", "lanes:forward": "1", "lanes:backward": "3"}, 3),
        ({}, None),
    ],
)
def test_lanes(spark, tags, lanes):
    df = spark.createDataFrame([(tags,)], "tags map<string, string>")
    assert df.select(read.lanes_per_direction(F.col("tags"))).first()[0] == lanes


@pytest.mark.parametrize("surface, paved", [("asphalt", True), ("asphalt;gravel", False), ("asphalt:lanes", True), ("concrete:plates", True), ("paved:x", False), (None, False), ("", False), ("metal_grid", True), ("gravel", False)])
def test_paved(spark, surface, paved):
    assert spark.range(1).select(read.is_paved(F.lit(surface).cast("string"))).first()[0] is paved


def test_rows_far_apart(spark):
    rng = random.Random(3)
    rows = [(i % 6, i, rng.uniform(0, 360)) for i in range(300)] + [(9, 1000, 5.0)]
    got = {}
    for r in graph.greedy_apart(spark.createDataFrame(rows, "area long, rank int, at double"), "area", ["rank"], "at", 40.0, 4).collect():
        got.setdefault(r.area, set()).add(r.rank)
    for area in {r[0] for r in rows}:
        kept = []
        for _, rank, at in sorted(r for r in rows if r[0] == area):
            if len(kept) < 4 and all(abs(at - x) >= 40 for _, x in kept):
                kept.append((rank, at))
        assert got[area] == {k for k, _ in kept}


def test_one_long_interval_stays_cheap(spark):
    """Short intervals don't meet one another in the buckets of a long one."""

    def seconds(rows):
        df = spark.createDataFrame(rows, "a long, k long, lo double, hi double")
        t = time.time()
        n = joins.interval_overlap_join(df, df.toDF("b", "k", "lo2", "hi2"), ["k"], ("lo", "hi"), ("lo2", "hi2"), 1.0).count()
        return n, time.time() - t

    short = [(i, 1, float(2 * i), 2 * i + 1.5) for i in range(20_000)]
    assert seconds(short)[0] == 20_000
    n, took = seconds([*short, (-1, 1, 0.0, 40_000.0)])
    assert n == 20_000 + 2 * 20_000 + 1
    df = spark.createDataFrame([*short, (-1, 1, 0.0, 40_000.0)], "a long, k long, lo double, hi double")
    plan = joins.interval_overlap_join(df, df.toDF("b", "k", "lo2", "hi2"), ["k"], ("lo", "hi"), ("lo2", "hi2"), 1.0)
    assert plan.count() == n and took < 60


def test_local_search_is_near_the_best(spark):
    rng = random.Random(9)
    for n in (5, 9, 12):
        points = [(rng.random(), rng.random()) for _ in range(n)]
        leg = [[((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 * (1 + 0.1 * (i < j)) for j, b in enumerate(points)] for i, a in enumerate(points)]
        best, _ = graph.best_order(leg)
        cost, order = graph.searched_order(leg)
        assert order[0] == 0 and order[-1] == n - 1 and sorted(order) == list(range(n))
        assert abs(cost - sum(leg[a][b] for a, b in zip(order, order[1:]))) < 1e-9 and best - 1e-9 <= cost <= 1.05 * best
    inf = [[None if (i, j) == (2, 3) else float(abs(i - j)) for j in range(20)] for i in range(20)]
    cost, order = graph.best_order(inf)
    assert cost < 40 and (2, 3) not in set(zip(order, order[1:]))


def test_moves_are_told_by_the_legs_they_change():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(5, 10))
        c, o = rng.random((n, n)), rng.permutation(n)
        whole = lambda p: float(c[p[:-1], p[1:]].sum())
        for size in (1, 2, 3):
            if n > size + 2:
                options = [[*o[:i], *o[i + size :]] for i in range(1, n - size)]
                best = min(whole(np.array([*rest[:k], *o[i : i + size], *rest[k:]])) for i, rest in enumerate(options, 1) for k in range(1, len(rest)) if k != i)
                assert abs(whole(o) + graph.moved(c, o, size)[0] - best) < 1e-9
        best = min(whole(np.concatenate([o[:i], o[i : j + 1][::-1], o[j + 1 :]])) for i in range(1, n - 2) for j in range(i + 1, n - 1))
        assert abs(whole(o) + graph.turned(c, o)[0] - best) < 1e-9


def test_parts_of_lists_are_trimmed(spark):
    df = spark.createDataFrame([("yes; no ;1x",)], "v string")
    assert df.select(read.parts(F.col("v"))).first()[0] == ["yes", "no", "1x"]
    assert df.select(read.most_restrictive(F.col("v"))).first()[0] == "no"
