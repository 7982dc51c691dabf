import heapq
import random

from roadweave.operators import network


def scene(seed, n=60, m=110):
    rng = random.Random(seed)
    return [(i, rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 40))) for i in range(m)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row long, u long, v long, cost double")


def test_spurs_by_taking_edges_off(spark):
    """Against a walk from every open end, round after round."""
    for seed in (1, 2):
        edges = [e for e in scene(seed, 50, 60) if e[1] != e[2]]
        live, gone = {e[0]: e for e in edges}, set()
        while True:
            at = {}
            for row, u, v, _ in live.values():
                at.setdefault(u, []).append(row)
                at.setdefault(v, []).append(row)
            off = set()
            for node in [x for x, r in at.items() if len(r) == 1]:
                path, here = [], node
                while True:
                    row = next(r for r in at[here] if r not in path)
                    path.append(row)
                    here = live[row][2] if live[row][1] == here else live[row][1]
                    if len(at[here]) != 2:
                        break
                if len(at[here]) > 2 and sum(live[r][3] for r in path) < 45:
                    off |= {*path}
            if not off:
                break
            gone |= off
            live = {r: e for r, e in live.items() if r not in off}
        assert {r.row for r in network.spurs(frame(spark, edges), 45.0).collect()} == gone and len(gone) > 5


def test_nearest_piece_and_links(spark):
    rng = random.Random(4)
    n = 70
    edges = [(i, rng.randrange(n), rng.randrange(n), float(rng.randrange(1, 40)) + i / 1000) for i in range(150)]
    inside = [(1000 + i, a := rng.randrange(0, n, 2), (a + 2) % n, 30.0) for i in range(12)]
    of = {}
    for r in network.pieces(frame(spark, inside)).collect():
        of[r.node] = r.piece
    around = {}
    for row, u, v, c in edges:
        around.setdefault(u, []).append((v, c, row))
        around.setdefault(v, []).append((u, c, row))

    def spread(start):
        best, queue = {x: 0.0 for x in start}, [(0.0, x) for x in start]
        while queue:
            d, x = heapq.heappop(queue)
            if d == best[x]:
                for y, c, _ in around.get(x, ()):
                    if d + c < best.get(y, 1e9):
                        best[y] = d + c
                        heapq.heappush(queue, (d + c, y))
        return best

    table = spark.createDataFrame(list(of.items()), "node long, piece long")
    near = {r.node: (round(r.d, 6), r.piece) for r in network.reached(frame(spark, edges), table, 50.0).collect()}
    from_piece = {p: spread([x for x, q in of.items() if q == p]) for p in {*of.values()}}
    want = {x: min((round(d[x], 6), p) for p, d in from_piece.items() if x in d) for x in range(n) if any(x in d for d in from_piece.values())}
    assert near == {x: v for x, v in want.items() if v[0] <= 50}
    # the forest that joins pieces by their cheapest ways, as one pass over all ways from piece to piece finds it
    limit = 60.0
    ways = sorted((min(from_piece[p].get(x, 1e9) for x, q in of.items() if q == r), p, r) for p in from_piece for r in from_piece if p < r)
    parent = {p: p for p in from_piece}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    cost = 0.0
    for d, p, r in ways:
        if d <= limit and root(p) != root(r):
            parent[root(p)] = root(r)
            cost += d
    rows = {r.row for r in network.connected(frame(spark, edges), table, frame(spark, inside), limit, 0.0).collect()}
    groups = {r.node: r.piece for r in network.pieces(frame(spark, [e for e in edges if e[0] in rows] + inside)).collect()}
    assert {frozenset(p for p in parent if root(p) == k) for k in {root(p) for p in parent}} == {frozenset(of[x] for x in of if groups[x] == g) for g in {groups[x] for x in of}}
    assert sum(e[3] for e in edges if e[0] in rows) <= cost + 1e-6
    size = {}
    for _, u, _, c in inside:
        size[root(of[u])] = size.get(root(of[u]), 0) + c
    few = {r.row for r in network.connected(frame(spark, edges), table, frame(spark, inside), limit, 100.0).collect()}
    assert few <= rows and (few == rows) == all(v >= 100 or not any(e[0] in rows and root(near[e[1]][1]) == k for e in edges) for k, v in size.items())


def test_empty_networks(spark):
    none = frame(spark, [])
    assert network.spurs(none, 5.0).count() == 0 and network.pieces(none).count() == 0
    assert network.connected(none, network.pieces(none), none, 5.0, 0.0).count() == 0
    assert [tuple(r) for r in network.pieces(frame(spark, [(1, 5, 5, 2.0), (2, 7, 6, 1.0)])).orderBy("node").collect()] == [(5, 5), (6, 6), (7, 6)]
