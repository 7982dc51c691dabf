import math
import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from roadweave.operators import thinning
from roadweave.streaming import alerts

PTS = "array<struct<x: double, y: double>>"


def test_overlaps_longest_first(spark):
    rng = random.Random(4)
    lines = []
    for i in range(60):
        y, x, length = rng.choice([0.0, 20.0, 200.0]), rng.uniform(0, 600), rng.choice([60.0, 120.0, 200.0])
        pts = [(x, y), (x + length, y)]
        lines.append((i, length, pts[::-1] if rng.random() < 0.4 else pts, rng.random() < 0.2))
    lines.append((99, 500.0, None, False))
    kept = []
    for i, length, pts, both in sorted(lines[:-1], key=lambda r: (-r[1], r[0])):
        steps = int(length // 10)
        hits = 0
        for k in range(steps + 1):
            x = pts[0][0] + (pts[1][0] - pts[0][0]) * k / steps
            hits += any(abs(p[0][1] - pts[0][1]) <= 25 and math.hypot(max(min(p[0][0], p[1][0]) - x, 0, x - max(p[0][0], p[1][0])), p[0][1] - pts[0][1]) <= 25 and (both or b or (p[1][0] > p[0][0]) == (pts[1][0] > pts[0][0])) for _, _, p, b in kept)
        if hits < 0.5 * (steps + 1):
            kept.append((i, length, pts, both))
    got = thinning.without_overlaps(spark.createDataFrame(lines, f"line long, length double, pts {PTS}, both boolean"))
    assert {r.line for r in got.collect()} == {k[0] for k in kept} and 5 < len(kept) < 50


def test_thin_profiles(spark):
    rng = np.random.default_rng(2)
    h = np.cumsum(rng.normal(0, 1, 5000))
    h[1000:1010] = np.nan
    rows = [(1, i, None if np.isnan(v) else float(v), float(g)) for i, (v, g) in enumerate(zip(h, rng.normal(0, 0.1, 5000)))] + [(2, i, 1.0, None) for i in range(50)]
    df = spark.createDataFrame(rows, "route int, i int, height double, grade double")
    left = thinning.thinned(df, "route", "i", "height", "grade", 400).collect()
    mine = sorted(r.i for r in left if r.route == 1)
    assert sum(r.route == 2 for r in left) == 50 and 250 < len(mine) <= 400 and mine[0] == 0 and mine[-1] == 4999
    assert int(np.nanargmax(h)) in mine and int(np.nanargmin(h)) in mine and any(1000 <= i < 1010 for i in mine)
    steep = max((r for r in rows if r[0] == 1), key=lambda r: abs(r[3]))
    assert steep[1] in mine
    for window in (7, 40):
        p = set(thinning.picks(h, rng.normal(0, 0.1, 5000), window).tolist())
        for a in range(0, 5000, window):
            part = h[a : a + window]
            if not np.isnan(part).all():
                assert a + int(np.nanargmax(part)) in p and a + int(np.nanargmin(part)) in p


def scene(spark):
    routes = spark.createDataFrame([(1, [(0.0, 0.0), (500.0, 0.0)]), (2, [(0.0, 100.0), (0.0, 600.0)]), (3, [(0.0, 0.0)])], f"route long, pts {PTS}")
    day = lambda d: datetime(2026, 5, d)
    closures = [(10, day(1), day(9), [(300.0, 5.0), (400.0, 5.0)]), (11, day(1), None, [(100.0, -5.0), (150.0, -5.0)]), (12, day(1), day(2), [(10.0, 0.0), (60.0, 0.0)]), (13, None, None, [(200.0, -50.0), (200.0, 50.0)]), (14, None, None, [(3.0, 300.0), (3.0, 310.0)]), (15, None, None, [(5.0, 5.0)])]
    return routes, closures


def test_alerts_now(spark):
    routes, closures = scene(spark)
    index = alerts.route_index(routes)
    df = spark.createDataFrame(closures, f"closure long, start timestamp, end timestamp, pts {PTS}")
    got = {(r.route, r.closure) for r in alerts.alerts(df, index, F.lit(datetime(2026, 5, 5))).collect()}
    assert got == {(1, 10), (1, 11), (2, 14)}
    assert alerts.alerts(df, index, F.lit(datetime(2026, 5, 5)), 1).count() == 2


def test_alerts_of_a_stream_come_once(spark, tmp_path):
    routes, closures = scene(spark)
    index = alerts.route_index(routes).cache()
    rows = [(c, datetime(2026, 5, 5, 10, k), pts) for k in range(3) for c, _, _, pts in closures]
    kind = f"closure long, seen timestamp, pts {PTS}"
    for k in range(3):
        spark.createDataFrame(rows[k * 6 : k * 6 + 6], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = alerts.alert_stream(stream, index, "seen", "1 hour").writeStream.format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert sorted((r.route, r.closure) for r in spark.table("told").collect()) == [(1, 10), (1, 11), (1, 12), (2, 14)]
    index.unpersist()
