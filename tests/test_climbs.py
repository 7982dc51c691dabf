import numpy as np
import pytest

from roadweave.functions import climbs, routes
from roadweave.operators import chains


def profile(*legs):
    """Samples every 20 m of legs (metres, grade in percent)."""
    at, e = [0.0], [100.0]
    for metres, grade in legs:
        for _ in range(int(metres / 20)):
            at.append(at[-1] + 20)
            e.append(e[-1] + 0.2 * grade)
    return np.array(at), np.array(e)


@pytest.mark.parametrize(
    "legs, want",
    [
        ([(1000, 0), (2000, 5), (1000, -3)], [(1000, 3000, 100, "4")]),
        ([(400, 20)], []),  # too short
        ([(3000, 0.9)], []),  # too flat
        ([(1000, 9), (200, -4), (1000, 9)], [(0, 2200, 172, "3")]),  # a dip of 8 m passes
        ([(1000, 9), (400, -10), (1000, 9)], [(0, 1000, 90, "4"), (1400, 2400, 90, "4")]),  # one of 40 m doesn't
        ([(1000, 9), (300, 0), (1000, 9)], [(0, 2300, 180, "3")]),  # a bench
        ([(1000, 9), (900, 0), (1000, 9)], [(0, 1000, 90, "4"), (1900, 2900, 90, "4")]),  # a long one
        ([(10000, 0.2), (1000, 9)], [(10000, 11000, 90, "4")]),  # the wall at the end
        ([(2000, -5), (1000, 9)], [(2000, 3000, 90, "4")]),
        ([(9000, 10)], [(0, 9000, 900, "HC")]),
        ([(1000, 3)], []),  # no category
    ],
)
def test_climbs_by_hand(legs, want):
    at, e = profile(*legs)
    got = [(at[a], at[b], round(gain), name) for a, b, gain, name in climbs.find_climbs(at, e)]
    assert [(x[2], x[3]) for x in got] == [(x[2], x[3]) for x in want]
    assert all(abs(g[0] - w[0]) <= 20 and abs(g[1] - w[1]) <= 20 for g, w in zip(got, want))


def test_sustained_rises_by_a_walk():
    """Against a walk that looks at one sample after another."""
    rng = np.random.default_rng(8)
    for _ in range(60):
        at = np.cumsum(rng.uniform(5, 60, 200))
        e = np.cumsum(rng.normal(0, rng.choice([0.5, 2.0]), 200))
        want, low = [], 0
        while low < 199:
            while low < 199 and e[low + 1] <= e[low]:
                low += 1
            top = low
            for j in range(low + 1, 200):
                if e[j] > e[top]:
                    top = j
                elif e[top] - e[j] > routes.DIP_M or at[j] - at[top] > routes.FLAT_M:
                    break
            if top == low:
                break
            if e[top] - e[low] >= routes.MIN_RISE_M:
                want.append((at[low], at[top], e[top] - e[low]))
            low = top
        assert routes.sustained(at, e, 1.0) == want and routes.sustained(at, -e, -1.0) == [(a, b, -r) for a, b, r in want]


def test_on_strokes(spark):
    """A stroke of lines drawn either way, 4 km long: one climb up it, one up its other side; none against a one-way."""
    at, e = profile((2000, 6), (2000, -6))
    lines, samples = [], []
    for i in range(40):
        flip, a = i % 2, 100.0 * i
        pts = [(a, 0.0), (a + 100, 0.0)]
        lines.append((i, pts[::-1] if flip else pts, 100.0))
        samples += [(i, float(100 - (at[j] - a) if flip else at[j] - a), float(e[j]), None) for j in range(5 * i, 5 * i + 6)]
    df = spark.createDataFrame(lines, "line long, pts array<struct<x: double, y: double>>, length double")
    placed = chains.along_chains(df, chains.strokes(df))
    told = climbs.stroke_samples(placed, spark.createDataFrame(samples, "line long, along double, height double, oneway int"))
    assert told.count() == 201
    found = {(r.reverse, r.start, r.end, round(r.gain), r.category) for r in climbs.climbs(told, both=True).collect()}
    assert found == {(False, 0.0, 2000.0, 120, "4"), (True, 4000.0, 2000.0, 120, "4")}
    barred = spark.createDataFrame([(*s[:3], -1 if s[0] == 30 else None) for s in samples], "line long, along double, height double, oneway int")
    # line 30 is drawn along the stroke: the second climb goes back over it
    assert {r.reverse for r in climbs.climbs(climbs.stroke_samples(placed, barred), both=True).collect()} == {False, True}
    against = spark.createDataFrame([(*s[:3], 1 if s[0] == 30 else None) for s in samples], "line long, along double, height double, oneway int")
    assert {r.reverse for r in climbs.climbs(climbs.stroke_samples(placed, against), both=True).collect()} == {False}
    gap = told.withColumn("height", (told["height"] + 0).cast("double")).where("along != 1000").unionByName(told.where("along = 1000").withColumn("height", told["height"] * float("nan")).selectExpr("chain", "along", "cast(null as double) height", "ahead", "back"))
    assert len(climbs.climbs(gap).collect()) == 2
    assert climbs.climbs(told.limit(0)).collect() == []
