"""Whole conflation against a plain pass over all pairs of lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import conflation, matching

PTS = "array<struct<x: double, y: double>>"


def course(a, b):
    return math.degrees(math.atan2(b[0] - a[0], b[1] - a[1])) % 360


def turn(a, b):
    d = abs(a - b) % 360
    return min(d, 360 - d)


def alike(a, b):
    return min(turn(a, b), 180 - turn(a, b)) <= 25


def plain_probes(pts, spacing):
    out, n = [], len(pts)
    for i in range(n - 1):
        low, high = i, i + 1
        while math.dist(pts[low], pts[high]) < 8 and (low, high) != (0, n - 1):
            low = max(0, low - 1)
            if high < n - 1 and math.dist(pts[low], pts[high]) < 8:
                high += 1
        steps = max(1, int(math.dist(pts[i], pts[i + 1]) // spacing))
        for s in range(0 if i == 0 else 1, steps + 1):
            t = s / steps
            out.append((pts[i][0] + (pts[i + 1][0] - pts[i][0]) * t, pts[i][1] + (pts[i + 1][1] - pts[i][1]) * t, course(pts[low], pts[high])))
    return out


def plain_near(probe, pts):
    """Distance, metres along and heading of the nearest segment."""
    best, start = None, 0.0
    for a, b in zip(pts, pts[1:]):
        m = math.dist(a, b)
        if m:
            t = min(1.0, max(0.0, ((probe[0] - a[0]) * (b[0] - a[0]) + (probe[1] - a[1]) * (b[1] - a[1])) / (m * m)))
            d = math.dist(probe[:2], (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t))
            if best is None or d < best[0] - 1e-12:
                best = (d, start + m * t, course(a, b))
        start += m
    return best


def agree(a, b):
    return None if a is None or b is None else a == b


def plain_conflate(ways, features):
    """matched {way: (feature, step)} by the rules, one way and line at a time."""
    length = {f["feature"]: sum(math.dist(a, b) for a, b in zip(f["pts"], f["pts"][1:])) for f in features}
    lined = {f["feature"]: f for f in features}
    of = {w["way"]: w for w in ways}
    named = lambda w, f: agree(w["name"], f["fname"]) is not False
    tried = []
    for w in ways:
        if w["trail"] or w["pts"][0] == w["pts"][-1]:
            continue
        probes = plain_probes(w["pts"], 20)
        for f in features:
            if f["pts"][0] == f["pts"][-1] or not alike(course(w["pts"][0], w["pts"][-1]), course(f["pts"][0], f["pts"][-1])):
                continue
            near = [(i, *plain_near(p, f["pts"])) for i, p in enumerate(probes)]
            near = [x for x in near if x[1] <= 20]
            if len(near) < 0.5 * len(probes) or not near or not named(w, f):
                continue
            total = length[f["feature"]]
            end = lambda x: x[2] <= 20 or x[2] >= total - 20
            past = (near[0][0] if end(near[0]) else 0) + (len(probes) - 1 - near[-1][0] if end(near[-1]) else 0)
            spans = [(f["feature"], min(x[2] for x in near), max(x[2] for x in near))]
            tried.append(((f["precedence"], -len(near) / (len(probes) - past), sum(x[1] for x in near) / len(near), w["way"], f["feature"]), spans))
    nearest = {}
    for rank, _ in tried:
        mine = (rank[2], not of[rank[3]]["freeway"])
        nearest[rank[4]] = min(mine, nearest.get(rank[4], mine))
    theirs = {f for f, (_, street) in nearest.items() if not street}
    for f in lined:
        sides = [{of[r[3]]["layer"] for r, _ in tried if r[4] == f and of[r[3]]["freeway"] == side} for side in (True, False)]
        if lined[f]["count"] >= 20_000 and all(sides) and sides[0] != sides[1]:
            theirs.add(f)
    held = [c for c in tried if c[0][4] in theirs and not of[c[0][3]]["freeway"]]
    matched, refused, claimed = {}, [], {}

    def place(rows, step):
        for rank, spans in sorted(rows):
            fits = all(min(hi, b) - max(lo, a) <= max(0, 0.25 * (hi - lo)) for f, lo, hi in spans for a, b in claimed.get(f, ()))
            if rank[3] in matched or not fits:
                refused.append((rank[3], rank[4]))
                continue
            matched[rank[3]] = (rank[4], step)
            for f, lo, hi in spans:
                claimed.setdefault(f, []).append((lo, hi))

    place([c for c in tried if c not in held], 1)
    street = {f for f, (_, s) in nearest.items() if s}
    used = {f for f, _ in matched.values()}
    place([c for c in held if c[0][4] in street and c[0][4] not in used], 2)
    stay = ({f for w, (f, s) in matched.items() if s == 1 and of[w]["freeway"]} | (theirs - street)) & theirs
    contested, rows = {r[3] for r, _ in tried}, []
    for w in ways:
        if w["trail"] or w["way"] in contested:
            continue
        probes, wins = plain_probes(w["pts"], 20), {}
        for p in probes:
            best = None
            for f in features:
                if named(w, f) and (w["freeway"] or f["feature"] not in stay) and (near := plain_near(p, f["pts"])) and near[0] <= 20 and alike(p[2], near[2]):
                    best = min(best or (1e9, 0, 0), (near[0], f["feature"], near[1]))
            if best:
                wins.setdefault(best[1], []).append(best)
        wins = {f: x for f, x in wins.items() if len(x) >= min(2, len(probes))}
        n = sum(map(len, wins.values()))
        if wins and n >= 0.5 * len(probes):
            first = min(lined[f]["precedence"] for f in wins)
            ranked, run = sorted((lined[f]["count"], f, len(x)) for f, x in wins.items() if lined[f]["precedence"] == first), 0
            for _, f, k in ranked:
                run += k
                if 2 * run >= sum(r[2] for r in ranked):
                    break
            rows.append(((first, -min(1.0, n / len(probes)), sum(x[0] for v in wins.values() for x in v) / n, w["way"], f), [(g, min(x[2] for x in v), max(x[2] for x in v)) for g, v in sorted(wins.items())]))
    place(rows, 3)
    added = {}
    for w, f in refused:
        street = of[w]["street"]
        if w not in matched and w not in added and of[w]["divided"] and street and any(g == f and of[o]["divided"] and of[o]["street"] == street for o, (g, _) in matched.items()):
            added[w] = (f, 4)
    return matched | added


def plain_blocks(ways, blocks):
    out = {}
    for w in ways:
        if w["trail"]:
            continue
        probes, wins = plain_probes(w["pts"], 20), {}
        for p in probes:
            options = []
            for f in blocks:
                says = agree(w["name"], f["fname"])
                if (w["required"] and says is not True) or (says is False and not (w["free"] and f["freeway_block"])):
                    continue
                near = plain_near(p, f["pts"])
                if near and near[0] <= 20 and alike(p[2], near[2]):
                    options.append(({True: 0, None: 1, False: 2}[says], near[0], f["feature"], turn(p[2], near[2]) <= 90, says))
            if options:
                best = min(options, key=lambda o: o[:3])
                wins.setdefault(best[2], []).append(best)
        kept = {f: x for f, x in wins.items() if len(x) >= min(2, len(probes))}
        if any(x[0][4] for x in kept.values()):
            kept = {f: x for f, x in kept.items() if x[0][4] is not False}
        if kept and sum(map(len, kept.values())) >= 0.5 * len(probes):
            out |= {(w["way"], f): (round(len(x) / len(probes), 9), x[0][4], 2 * sum(o[3] for o in x) >= len(x)) for f, x in kept.items()}
    return out


def scene(seed, n=120, m=80):
    """Streets 14 apart in pairs, ways and lines broken at different places along them, some crossing, some curved."""
    rng = random.Random(seed)

    def line(lo, hi):
        row, x, length = rng.randrange(6), rng.uniform(0, 500), rng.uniform(lo, hi)
        y, bend = row * 37 + rng.choice([0, 0, 14]) + rng.uniform(-3, 3), rng.choice([0, 0, 0, 30])
        pts = [(x, y), (x + length / 2, y + bend), (x + length / 2 + 3, y + bend), (x + length, y + rng.uniform(-2, 2))]
        if rng.random() < 0.15:
            pts = [(q, p) for p, q in pts]
        return [(round(a, 3), round(b, 3)) for a, b in (pts[::-1] if rng.random() < 0.5 else pts)]

    names = [None, "a", "a", "b"]
    ways = [dict(way=i, pts=line(15, 420), name=rng.choice(names), street=rng.choice(["a", "b"]), trail=rng.random() < 0.05, freeway=rng.random() < 0.15, divided=rng.random() < 0.6, layer=rng.randrange(2), required=rng.random() < 0.1, free=rng.random() < 0.3) for i in range(n)]
    features = [dict(feature=1000 + i, pts=line(30, 110), precedence=rng.randrange(2), count=rng.choice([500, 900, 25_000]), fname=rng.choice(names), freeway_block=rng.random() < 0.3) for i in range(m)]
    return ways, features


WAY = f"way long, pts {PTS}, name string, street string, trail boolean, freeway boolean, divided boolean, layer int, required boolean, free boolean"
LINE = f"feature long, pts {PTS}, precedence int, count long, fname string, freeway_block boolean"


@pytest.mark.parametrize("seed", [2])
def test_against_all_pairs(spark, seed):
    ways, features = scene(seed)
    w, f = spark.createDataFrame([tuple(x.values()) for x in ways], WAY), spark.createDataFrame([tuple(x.values()) for x in features], LINE)
    said = F.col("name") == F.col("fname")
    matched, refused = matching.conflate(w, f, said)
    got, want = {r.way: (r.feature, r.step) for r in matched.collect()}, plain_conflate(ways, features)
    assert got == want
    assert {1, 3} <= {s for _, s in got.values()} and len(got) > 20
    assert not {(r.way, r.feature) for r in refused.collect()} & {(k, v[0]) for k, v in got.items() if v[1] < 4}
    blocks = {(r.way, r.feature): (round(r.share, 9), r.agrees, r.with_line) for r in matching.block_shares(w, f, said).collect()}
    assert blocks == plain_blocks(ways, features) and len(blocks) > 20


def test_claims_in_rounds_equal_one_pass(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        spans = [(rng.randrange(6), (lo := rng.uniform(0, 1000)), lo + rng.choice([0, 5, 40, 300])) for _ in range(rng.choice([0, 1, 1, 2]))]
        rows.append((i // 2, (rng.randrange(3), i), spans))
    df = spark.createDataFrame(rows, "owner long, rank struct<p: int, i: int>, spans array<struct<feature: long, lo: double, hi: double>>")
    held = spark.createDataFrame([(-1, [(3, 100.0, 200.0)])], "owner long, spans array<struct<feature: long, lo: double, hi: double>>")
    for finish in (0, 60, 1000):
        assert {r.rank.i for r in conflation.exclusive(df, held=held, finish=finish).collect()} == plain_claims(rows, [(3, 100.0, 200.0)])


def plain_claims(rows, held):
    taken, done, kept = list(held), set(), set()
    for owner, rank, spans in sorted(rows, key=lambda r: r[1]):
        if spans and owner not in done and all(min(hi, b) - max(lo, a) <= max(0, 0.25 * (hi - lo)) for f, lo, hi in spans for g, a, b in taken if f == g):
            kept.add(rank[1])
            done.add(owner)
            taken += spans
    return kept


def test_odd_lines(spark):
    """Lines of one point, of null points and of no length are left out; a long segment is met anywhere along it."""
    ways = spark.createDataFrame([(1, [(0.0, 0.0)]), (2, [(0.0, 0.0), (None, 1.0)]), (3, None), (4, [(4000.0, 5.0), (4100.0, 5.0)]), (5, [(7.0, 7.0), (7.0, 7.0)])], f"way long, pts {PTS}")
    lines = spark.createDataFrame([(9, [(0.0, 0.0), (9000.0, 0.0)], 0, 5), (8, [(0.0, 0.0)], 0, 5), (7, [], 0, 5)], f"feature long, pts {PTS}, precedence int, count long")
    matched, _ = matching.conflate(ways, lines)
    assert [tuple(r) for r in matched.collect()] == [(4, 9, 1.0, 1)]
    assert matching.conflate(ways.limit(0), lines)[0].count() == 0


def test_leftover_blocks(spark):
    """A connector between a way's probes runs along a matched way; a cross street doesn't."""
    ways = spark.createDataFrame([(1, [(0.0, 0.0), (200.0, 0.0)], None)], f"way long, pts {PTS}, name string")
    blocks = spark.createDataFrame([(10, [(0.0, 2.0), (95.0, 2.0)], None), (11, [(96.0, 2.0), (99.0, 2.0)], None), (12, [(100.0, 2.0), (200.0, 2.0)], None), (13, [(50.0, -30.0), (50.0, 30.0)], None)], f"feature long, pts {PTS}, fname string")
    shares = matching.block_shares(ways, blocks, F.lit(None).cast("boolean"))
    assert {r.feature for r in shares.collect()} == {10, 12}
    assert [r.feature for r in matching.unmatched_blocks(shares, ways, blocks).collect()] == [13]
    assert spark.range(1).select(matching.same_road(F.lit(False), F.lit("I-95;MD 97"), F.lit("md97"))).first()[0] is True
    assert spark.range(1).select(matching.same_road(F.lit(False), F.lit(None).cast("string"), F.lit("md97"))).first()[0] is False
