import math
import random

import numpy as np

from roadweave.functions import routes


def climbs_by_hand(points, sign):
    """Every low and the highest point that is reached from it without a dip or a flat that is too large."""
    out, i = [], 0
    while i + 1 < len(points):
        if sign * points[i + 1][1] <= sign * points[i][1]:
            i += 1
            continue
        top = i
        for j in range(i + 1, len(points)):
            if sign * points[j][1] > sign * points[top][1]:
                top = j
            elif sign * (points[top][1] - points[j][1]) > 3 or points[j][0] - points[top][0] > 150:
                break
        if sign * (points[top][1] - points[i][1]) >= 5:
            out.append((points[i][0], points[top][0], points[top][1] - points[i][1]))
        i = top
    return out


def test_climbs_and_climbed(spark):
    rng, rows, want = random.Random(3), [], []
    for r in range(12):
        h, piece = 100.0, []
        for k in range(80):
            h += rng.choice([-4, -2, -1, 0, 0, 1, 2, 3, 6])
            gone = rng.random() < 0.04
            rows.append((r, 30.0 * k, None if gone else h))
            if gone:
                want += [(r, *c) for s in (1, -1) for c in climbs_by_hand(piece, s)]
                piece = []
            else:
                piece.append((30.0 * k, h))
        want += [(r, *c) for s in (1, -1) for c in climbs_by_hand(piece, s)]
    df = spark.createDataFrame(rows, "route int, along double, height double")
    runs = routes.climb_runs(df)
    got = sorted(map(tuple, runs.collect()))
    assert got == sorted(want) and any(c[3] > 0 for c in got) and any(c[3] < 0 for c in got)
    ups = [c for c in want if c[3] > 0]
    for r in routes.climbed_along(df, runs, "route", "along").collect():
        on = [c for c in ups if c[0] == r.route and c[1] <= r.along <= c[2]]
        assert r.climbed == (r.along - max(c[1] for c in on) if on else 0.0)
    assert routes.climb_runs(df.limit(0)).collect() == []


def test_climb_cost(spark):
    df = spark.createDataFrame([(0.0, 1150.0, 57.5), (0.0, 100.0, 20.0), (0.0, 500.0, -40.0)], "a double, b double, r double")
    got = [x.c for x in df.select(routes.climb_cost_s(df.a, df.b, df.r).alias("c")).collect()]
    assert math.isclose(got[0], 1.7 * 0.02 * (1 + 0.02 / 0.03) * 1000 * 2, rel_tol=1e-9) and got[1:] == [0.0, 0.0]


def test_simplified_lines(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 60):
        p = np.cumsum(rng.normal(size=(n, 2)), axis=0)
        keep = routes.simplified(p, 1.0)
        kept = np.flatnonzero(keep)
        assert keep[0] and keep[-1]
        for a, b in zip(kept, kept[1:]):
            for q in p[a + 1 : b]:
                t = np.clip((q - p[a]) @ (p[b] - p[a]) / ((p[b] - p[a]) @ (p[b] - p[a])), 0, 1)
                assert np.linalg.norm(q - p[a] - t * (p[b] - p[a])) <= 1.0
    assert routes.simplified(np.array([[0.0, 0], [1, 0], [2, 0.01], [3, 0]]), 0.5).tolist() == [True, False, False, True]
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.1), (1, 2, 2.0, 0.0), (2, 0, 5.0, 5.0)], "route int, o int, x double, y double")
    assert {(r.route, r.o) for r in routes.simplify(df, "route", "o", "x", "y", 0.5).collect()} == {(1, 0), (1, 2), (2, 0)}


def decoded(line):
    out, values, shift, number = [], [0, 0], 0, 0
    for c in line:
        v = ord(c) - 63
        number |= (v & 31) << shift
        shift += 5
        if v < 32:
            out.append(-(number + 1) // 2 if number & 1 else number // 2)
            shift = number = 0
    points = []
    for a, b in zip(out[::2], out[1::2]):
        values = [values[0] + a, values[1] + b]
        points.append(tuple(values))
    return points


def test_polylines(spark):
    rng = random.Random(4)
    rows = [(r, k, round(rng.uniform(-180, 180), 6), round(rng.uniform(-90, 90), 6)) for r in range(4) for k in range(20)] + [(9, 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "route int, o int, lon double, lat double")
    for r in routes.polylines(df, "route", "o", "lon", "lat").collect():
        assert decoded(r.line) == [(round(lat * 1e6), round(lon * 1e6)) for q, _, lon, lat in rows if q == r.route]
    # the published example of the format, of five digits
    known = spark.createDataFrame([(1, 0, -120.2, 38.5), (1, 1, -120.95, 40.7), (1, 2, -126.453, 43.252)], "route int, o int, lon double, lat double")
    assert routes.polylines(known, "route", "o", "lon", "lat", 5).first().line == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
