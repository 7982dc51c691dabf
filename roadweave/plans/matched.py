"""Whole conflation: agency lines and blocks on ways. Streets 60 apart; ways and lines break at different places along them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.operators import matching, rematch, thinning
from roadweave.plans.registry import query
from roadweave.session import table
from roadweave.streaming import alerts

def agree():
    return F.col("name") == F.col("fname")


def line(*points):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def ways(spark, sf_dir):
    k = F.col("c_custkey")
    x, y = k % 40 * 50, F.floor(k / 40) * 60 + k % 3 * 6
    bend = y + k % 5 * 2
    return table(spark, sf_dir, "customer").select(
        k.alias("way"), line((x, y), (x + 30, bend), (x + 65 + k % 7 * 15, bend)).alias("pts"), F.when(k % 4 > 0, F.concat(F.lit("n"), (F.floor(k / 40) % 2).cast("string"))).alias("name"),
        (F.floor(k / 40) % 2).cast("string").alias("street"), (k % 23 == 0).alias("trail"), (k % 10 == 0).alias("required"), (k % 6 == 0).alias("free"),
        (k % 9 == 0).alias("freeway"), (k % 2 == 0).alias("divided"), (k % 3).cast("int").alias("layer"),
    )


def lines(spark, sf_dir):
    p = F.col("p_partkey")
    x, y = p % 53 * 38, F.floor(p / 53) * 60 + p % 4 * 5
    a, b, c = (x, y), (x + 45, y + p % 3 * 3), (x + 75, y + p % 3 * 3)
    across = (x, y + 60)
    return table(spark, sf_dir, "part").select(
        p.alias("feature"), F.when(p % 9 == 0, line(a, across)).when(p % 2 == 1, line(c, b, a)).otherwise(line(a, b, c)).alias("pts"),
        F.when(p % 11 == 0, "other").when(p % 5 > 0, F.concat(F.lit("n"), (F.floor(p / 53) % 2).cast("string"))).alias("fname"), (p % 7 == 0).alias("freeway_block"),
        (p % 2).cast("int").alias("precedence"), (p * 37 % 30000).alias("count"),
    )


@query()
def whole_conflation(spark, sf_dir):
    return matching.conflate(ways(spark, sf_dir), lines(spark, sf_dir), agree())[0].withColumn("share", F.round("share", 9))


SCENE = """w AS (
        SELECT c_custkey AS way, (c_custkey % 40 * 50)::DOUBLE AS x0, (c_custkey // 40 * 60 + c_custkey % 3 * 6)::DOUBLE AS y0, c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN 'n' || (c_custkey // 40 % 2) END AS name
        FROM customer WHERE c_custkey % 23 <> 0),
    ws AS (SELECT way, k, name, 1 AS i, x0 AS ax, y0 AS ay, x0 + 30 AS bx, y0 + k % 5 * 2 AS b_y FROM w UNION ALL SELECT way, k, name, 2, x0 + 30, y0 + k % 5 * 2, x0 + 65 + k % 7 * 15, y0 + k % 5 * 2 FROM w),
    wl AS (SELECT *, greatest(1, floor(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) / 20)::INT) AS steps FROM ws),
    probes AS (
        SELECT way, k, name, row_number() OVER (PARTITION BY way ORDER BY i, s.s) - 1 AS slot, count(*) OVER (PARTITION BY way) AS probes, ax + (bx - ax) * (s.s / steps) AS x, ay + (b_y - ay) * (s.s / steps) AS y,
            degrees(atan2(bx - ax, b_y - ay)) AS h FROM wl, range(CASE i WHEN 1 THEN 0 ELSE 1 END, steps + 1) s(s)),
    p AS (SELECT p_partkey AS feature, p_partkey AS p, (p_partkey % 53 * 38)::DOUBLE AS x, (p_partkey // 53 * 60 + p_partkey % 4 * 5)::DOUBLE AS y, CASE WHEN p_partkey % 11 = 0 THEN 'other' WHEN p_partkey % 5 > 0 THEN 'n' || (p_partkey // 53 % 2) END AS fname FROM part),
    fs AS (
        SELECT feature, p, fname, 0 AS seq, x AS ax, y AS ay, x AS bx, y + 60 AS b_y FROM p WHERE p % 9 = 0
        UNION ALL SELECT feature, p, fname, 0, x, y, x + 45, y + p % 3 * 3 FROM p WHERE p % 9 > 0 AND p % 2 = 0
        UNION ALL SELECT feature, p, fname, 1, x + 45, y + p % 3 * 3, x + 75, y + p % 3 * 3 FROM p WHERE p % 9 > 0 AND p % 2 = 0
        UNION ALL SELECT feature, p, fname, 0, x + 75, y + p % 3 * 3, x + 45, y + p % 3 * 3 FROM p WHERE p % 9 > 0 AND p % 2 = 1
        UNION ALL SELECT feature, p, fname, 1, x + 45, y + p % 3 * 3, x, y FROM p WHERE p % 9 > 0 AND p % 2 = 1),
    met AS (
        SELECT way, k, name, slot, probes, h, feature, p, fname, seq, degrees(atan2(bx - ax, b_y - ay)) AS fh, x, y, ax, ay, bx, b_y,
            greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))) AS t
        FROM probes JOIN fs ON x BETWEEN least(ax, bx) - 20 AND greatest(ax, bx) + 20 AND y BETWEEN least(ay, b_y) - 20 AND greatest(ay, b_y) + 20),
    d AS (SELECT *, (ax + (bx - ax) * t - x) * (ax + (bx - ax) * t - x) + (ay + (b_y - ay) * t - y) * (ay + (b_y - ay) * t - y) AS d2 FROM met),
    near AS (
        SELECT way, slot, feature, any_value(k) AS k, any_value(name) AS name, any_value(probes) AS probes, any_value(p) AS p, any_value(fname) AS fname, sqrt(min(d2)) AS distance,
            abs(any_value(h) - min_by(fh, (d2, seq))) AS delta FROM d WHERE d2 <= 400 GROUP BY 1, 2, 3)"""


@query(
    f"""WITH {SCENE},
    turned AS (SELECT *, least(delta, 360 - delta) AS turn, name = fname AS agrees FROM near),
    may AS (
        SELECT *, CASE WHEN agrees IS NULL THEN 1 WHEN agrees THEN 0 ELSE 2 END AS rank FROM turned
        WHERE least(turn, 180 - turn) <= 25 AND (k % 10 <> 0 OR coalesce(agrees, false)) AND (coalesce(agrees, true) OR (k % 6 = 0 AND p % 7 = 0))),
    best AS (SELECT *, row_number() OVER (PARTITION BY way, slot ORDER BY rank, distance, feature) AS rn FROM may),
    shares AS (SELECT way, feature, count(*) AS n, any_value(probes) AS probes, any_value(agrees) AS agrees, 2 * count(*) FILTER (turn <= 90) >= count(*) AS with_line FROM best WHERE rn = 1 GROUP BY 1, 2 HAVING count(*) >= least(2, any_value(probes))),
    known AS (SELECT *, bool_or(coalesce(agrees, false)) OVER (PARTITION BY way) AS known FROM shares),
    held AS (SELECT *, sum(n) OVER (PARTITION BY way) AS total FROM known WHERE NOT known OR coalesce(agrees, true))
    SELECT way, feature, round(n / probes, 9) AS share, agrees, with_line FROM held WHERE total >= 0.5 * probes"""
)
def block_shares(spark, sf_dir):
    return matching.block_shares(ways(spark, sf_dir), lines(spark, sf_dir), agree()).withColumn("share", F.round("share", 9))


# A row for each customer's way, and by turns what became of it: as it was, a new id, split, merged, redrawn, renamed, gone, two side by side.
@query(
    """WITH k AS (SELECT c_custkey % 8 AS k, count(*) AS rows FROM customer GROUP BY 1)
    SELECT * FROM (SELECT CASE k WHEN 1 THEN 'rematched' WHEN 2 THEN 'rematched' WHEN 3 THEN 'failed' WHEN 4 THEN 'drifted' WHEN 5 THEN 'drifted' WHEN 6 THEN 'failed' WHEN 7 THEN 'failed' END AS outcome,
        CASE k WHEN 2 THEN 'split' WHEN 3 THEN 'merged' WHEN 4 THEN 'redrawn' WHEN 5 THEN 'tags' WHEN 6 THEN 'none' WHEN 7 THEN 'parallel' END AS reason, CASE k WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END AS ways, rows FROM k WHERE k > 0)"""
)
def override_rematch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), (F.col("c_custkey") % 8).alias("k"))
    x, y, k = F.col("c") % 40 * 200, F.floor(F.col("c") / 40) * 100, F.col("k")
    name, bar = F.concat(F.lit("Road "), F.col("c").cast("string")), lambda a, b, up=0: line((x + a, y + up), (x + b, y + up))
    rows = c.select(F.col("c").alias("row"), F.lit("stress").alias("kind"), F.col("c").alias("way"), (F.col("c") % 5).alias("value"), name.alias("name"), F.lit("residential").alias("highway"), F.lit(50.0).alias("length"), bar(0, 50).alias("pts"))
    new = F.col("c") + 1_000_000_000
    way = lambda id_, pts, named=name: F.struct(id_.alias("way"), named.alias("name"), F.lit("residential").alias("highway"), pts.alias("pts"))
    now = (
        F.when(k == 0, F.array(way(F.col("c"), bar(0, 50)))).when(k == 1, F.array(way(new, bar(50, 0)))).when(k == 2, F.array(way(F.col("c"), bar(0, 25)), way(new, bar(25, 50))))
        .when(k == 3, F.array(way(F.col("c"), bar(0, 90)))).when(k == 4, F.array(way(F.col("c"), bar(0, 50, 12)))).when(k == 5, F.array(way(F.col("c"), bar(0, 50), F.lit("Other Road"))))
        .when(k == 7, F.array(way(new, bar(0, 50)), way(new + 1_000_000_000, bar(0, 50, 3))))
    )
    report, _ = rematch.rematch(rows, c.select(F.explode(now).alias("w")).select("w.*"))
    return report.groupBy("outcome", "reason", F.coalesce(F.size("ways"), F.lit(0)).alias("ways")).agg(F.count("*").alias("rows"))


# Customers' saved routes along streets; suppliers' closures beside them, some across.
@query(
    """WITH r AS (SELECT c_custkey AS route, c_custkey % 40 * 50 AS x, c_custkey // 40 * 60 AS y FROM customer),
    c AS (SELECT s_suppkey AS closure, s_suppkey % 40 * 50 + 10 AS x, s_suppkey * 15 // 40 * 60 + s_suppkey % 5 * 5 AS y FROM supplier WHERE s_suppkey % 9 > 0 AND s_suppkey % 4 > 0),
    met AS (SELECT route, closure, greatest(0, greatest(r.x, c.x) - least(r.x + 200, c.x + 80)) AS gap, c.y - r.y AS up FROM r JOIN c ON abs(c.y - r.y) <= 15),
    n AS (SELECT route, closure, row_number() OVER (PARTITION BY route ORDER BY closure) AS n FROM met WHERE gap * gap + up * up <= 225)
    SELECT route, closure FROM n WHERE n <= 5"""
)
def route_alerts(spark, sf_dir):
    """The first five closures in force along each saved route."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    x, y = k % 40 * 50, F.floor(k / 40) * 60
    routes = table(spark, sf_dir, "customer").select(k.alias("route"), line((x, y), (x + 200, y)).alias("pts"))
    u, v = s % 40 * 50 + 10, F.floor(s * 15 / 40) * 60 + s % 5 * 5
    moment = F.to_timestamp(F.lit("2026-05-05 10:00:00"))
    over = F.when(s % 4 == 0, F.to_timestamp(F.lit("2026-05-04 10:00:00")))
    shut = table(spark, sf_dir, "supplier").select(s.alias("closure"), F.lit(None).cast("timestamp").alias("start"), over.alias("end"), F.when(s % 9 == 0, line((u, v - 40), (u, v + 40))).otherwise(line((u, v), (u + 80, v))).alias("pts"))
    return alerts.alerts(shut, alerts.route_index(routes), moment).select("route", "closure")


@query()
def lines_kept(spark, sf_dir):
    """Parts' lines without those that mostly lie on longer ones."""
    p = lines(spark, sf_dir)
    return thinning.without_overlaps(p.select(F.col("feature").alias("line"), (F.col("feature") * 37 % 1000).cast("double").alias("length"), "pts", (F.col("feature") % 6 == 0).alias("both"))).select("line", "length")


@query()
def thin_profiles(spark, sf_dir):
    """The samples of suppliers' profiles that show their shape."""
    item = table(spark, sf_dir, "lineitem")
    samples = item.select(F.col("l_suppkey").alias("route"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("i"), F.when(F.col("l_quantity") > 1, F.col("l_extendedprice") / 1000).alias("height"), (F.col("l_discount") - 0.05).alias("grade"))
    placed = samples.withColumn("i", F.row_number().over(Window.partitionBy("route").orderBy("i")))
    return thinning.thinned(placed, "route", "i", "height", "grade", 200)
