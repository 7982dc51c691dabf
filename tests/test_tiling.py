import math
import random

from roadweave.operators import tiling

PTS = "array<struct<x: double, y: double>>"


def test_clipping_by_samples():
    """Places along a line, or in a polygon, are inside the square exactly if they are in what is left."""
    rng = random.Random(6)
    for _ in range(200):
        line = [(rng.uniform(-50, 150), rng.uniform(-50, 150)) for _ in range(rng.randrange(2, 6))]
        parts = tiling.line_parts(line, 0.0, 100.0)
        want = sum(math.dist(a, b) / 500 * sum(all(0 <= u + (v - u) * (k + 0.5) / 500 <= 100 for u, v in zip(a, b)) for k in range(500)) for a, b in zip(line, line[1:]))
        assert abs(sum(math.dist(a, b) for p in parts for a, b in zip(p, p[1:])) - want) < 3
        assert all(-1e-9 <= c <= 100 + 1e-9 for p in parts for q in p for c in q)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(7))
        ring = [(50 + 90 * math.cos(t), 50 + 60 * math.sin(t)) for t in turns]
        left = tiling.ring_inside(ring, 0.0, 100.0)

        def held(p, r):
            return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:] + r[:1])) % 2 == 1

        for _ in range(60):
            p = (rng.uniform(-40, 140), rng.uniform(-20, 120))
            if min(abs(c - e) for c in p for e in (0, 100)) > 0.01:
                assert held(p, left) == (held(p, ring) and all(0 <= c <= 100 for c in p))


def test_merged_lines(spark):
    rows = [(1, [(0.0, 0.0), (1.0, 0.0)], "a"), (2, [(2.0, 0.0), (1.0, 0.0)], "a"), (3, [(2.0, 0.0), (3.0, 1.0)], "a"), (4, [(3.0, 1.0), (4.0, 1.0)], "b"), (5, [(3.0, 1.0), (3.0, 5.0)], "a"), (6, [(3.0, 1.0), (9.0, 9.0)], "a"), (7, [(7.0, 7.0)], "a")]
    got = {(r.name, tuple((p.x, p.y) for p in r.pts)) for r in tiling.merged_lines(spark.createDataFrame(rows, f"line long, pts {PTS}, name string"), ["name"]).collect()}
    assert got == {("a", ((0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 1.0))), ("b", ((3.0, 1.0), (4.0, 1.0))), ("a", ((3.0, 1.0), (3.0, 5.0))), ("a", ((3.0, 1.0), (9.0, 9.0)))}


def test_tiles_hold_what_crosses_them(spark):
    rng = random.Random(2)
    rows = [(i, "line", [(rng.random(), rng.random()) for _ in range(3)], f"n{i}") for i in range(30)]
    rows += [(100, "polygon", [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9), (0.1, 0.1)], "square"), (101, "point", [(0.3, 0.3)], "spot"), (102, "line", [(0.5, 0.5), (0.5, 0.5)], "dot"), (103, "line", [(0.2, 0.2), (0.20001, 0.20001), (0.4, 0.4)], "straight")]
    got = tiling.tile_features(spark.createDataFrame(rows, f"id long, kind string, pts {PTS}, name string"), 3).collect()
    tiles = {}
    for r in got:
        assert all(-64 <= c <= 4096 + 64 for p in r.points for c in (p.x, p.y))
        tiles.setdefault(r.id, {}).setdefault((r.tx, r.ty), []).append([(p.x, p.y) for p in r.points])
    for i, kind, pts, _ in rows:
        if kind == "line" and i != 102:
            want = set()
            for a, b in zip(pts, pts[1:]):
                want |= {(int((a[0] + (b[0] - a[0]) * k / 2000) * 8), int((a[1] + (b[1] - a[1]) * k / 2000) * 8)) for k in range(2001)}
            assert want - set(tiles[i]) == set() or max(len(want - set(tiles[i])), 0) <= 1
    assert set(tiles[100]) == {(x, y) for x in range(8) for y in range(8)}
    assert tiles[100][(3, 3)] == [[(-64, -64), (4160, -64), (4160, 4160), (-64, 4160)]] or len(tiles[100][(3, 3)][0]) == 4
    assert tiles[101] == {(2, 2): [[(1638, 1638)]]} and 102 not in tiles
    assert all(len(p) == 2 for parts in tiles[103].values() for p in parts)
    assert tiling.tile_features(spark.createDataFrame([], f"id long, kind string, pts {PTS}"), 3).collect() == []
