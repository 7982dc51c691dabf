"""Queries of route measures: a user's events are a route's samples, in order of time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.functions import routes
from roadweave.plans.registry import query
from roadweave.session import table

# A sample every 40 m; errors have no height; places on a small grid of streets.
SAMPLES = """s AS (SELECT user_id AS route, event_id, CAST(40 * (row_number() OVER w - 1) AS DOUBLE) AS along, CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS DOUBLE) % 50 END AS height,
    CAST(event_id * 7919 % 331 AS DOUBLE) AS x, CAST(event_id * 104729 % 337 AS DOUBLE) AS y, event_type, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def samples(spark, sf_dir):
    e, w = table(spark, sf_dir, "events"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    along = (40 * (F.row_number().over(w) - 1)).cast("double")
    height = F.when(F.col("event_type") != "error", F.floor("value").cast("double") % 50)
    k = F.col("event_id")
    return e.select(F.col("user_id").alias("route"), k, along.alias("along"), height.alias("height"), (k * 7919 % 331).cast("double").alias("x"), (k * 104729 % 337).cast("double").alias("y"), "event_type", "value")


@query(
    f"""WITH {SAMPLES}, g AS (SELECT *, sum(CASE WHEN height IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY along) AS gap FROM s),
    a AS (SELECT p.route, p.along, arg_max(q.height, q.along) - arg_min(q.height, q.along) AS rise, max(q.along) - min(q.along) AS run FROM g p JOIN g q ON p.route = q.route AND p.gap = q.gap AND q.height IS NOT NULL AND abs(p.along - q.along) <= 80 WHERE p.height IS NOT NULL GROUP BY 1, 2)
    SELECT s.route, s.along, CAST(round(1e6 * rise / nullif(run, 0)) AS BIGINT) AS grade_ppm FROM s LEFT JOIN a USING (route, along)"""
)
def sample_grades(spark, sf_dir):
    g = routes.grades(samples(spark, sf_dir), "route", "along", "height")
    return g.select("route", "along", F.round(1e6 * F.col("grade")).cast("long").alias("grade_ppm"))


@query()
def sustained_climbs(spark, sf_dir):
    runs = routes.climb_runs(samples(spark, sf_dir))
    return runs.withColumn("cost_s", routes.climb_cost_s(F.col("start"), F.col("end"), F.col("rise")))


@query()
def climbed_metres(spark, sf_dir):
    s = samples(spark, sf_dir).select("route", "along", "height")
    return routes.climbed_along(s, routes.climb_runs(s), "route", "along")


@query(
    f"""WITH {SAMPLES}, hit AS (SELECT DISTINCT p.route, p.along FROM s p JOIN s q ON p.route = q.route AND abs(p.along - q.along) > 400 AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 < 625),
    f AS (SELECT s.route, s.along, hit.along IS NOT NULL AS now FROM s LEFT JOIN hit USING (route, along)), n AS (SELECT *, now AND NOT coalesce(lag(now) OVER (PARTITION BY route ORDER BY along), false) AS new FROM f)
    SELECT route, CAST(count(*) FILTER (WHERE new) // 2 AS BIGINT) AS revisits FROM n GROUP BY 1"""
)
def route_revisits(spark, sf_dir):
    return routes.revisits(samples(spark, sf_dir), "route", "along", "along", "x", "y")


@query(
    f"""WITH {SAMPLES}, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM s WINDOW w AS (PARTITION BY route ORDER BY along)),
    h AS (SELECT *, sqrt(dx * dx + dy * dy) AS step, CASE WHEN sqrt(dx * dx + dy * dy) >= 0.5 THEN atan2(dy, dx) END AS heading FROM d),
    t AS (SELECT *, heading - lag(heading IGNORE NULLS) OVER (PARTITION BY route ORDER BY along) AS turn FROM h)
    SELECT route, CAST(round(coalesce(sum(step), 0) * 1000) AS BIGINT) AS length_mm, CAST(round(coalesce(sum(degrees(least(abs(turn), 2 * pi() - abs(turn)))), 0)) AS BIGINT) AS degrees FROM t GROUP BY 1"""
)
def line_bends(spark, sf_dir):
    b = routes.bends(samples(spark, sf_dir), "route", "along", "x", "y")
    return b.select("route", F.round(F.col("length") * 1000).cast("long").alias("length_mm"), F.round("degrees").cast("long").alias("degrees"))


@query(
    """WITH p AS (SELECT l_orderkey AS route, CAST(l_linenumber * 250 AS DOUBLE) AS a, CAST(l_linenumber * 250 + 250 AS DOUBLE) AS b FROM lineitem GROUP BY ALL),
    w AS (SELECT o_orderkey AS route, CAST(floor(o_totalprice) AS BIGINT) % 1500 AS c, CAST(floor(o_totalprice) AS BIGINT) % 7 AS extra FROM orders)
    SELECT p.route, a AS start, b AS end, CAST(round(1e6 * (1 + 0.25 * coalesce(sum(extra * (least(b, c + 300) - greatest(a, c)) / 250), 0))) AS BIGINT) AS factor_ppm FROM p LEFT JOIN w ON p.route = w.route AND a < c + 300 AND c < b GROUP BY 1, 2, 3"""
)
def hill_shares(spark, sf_dir):
    n, price = F.col("l_linenumber"), F.floor("o_totalprice")
    pieces = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), (n * 250).cast("double").alias("start"), (n * 250 + 250).cast("double").alias("end")).distinct()
    windows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route"), (price % 1500).cast("double").alias("w_start"), (price % 1500 + 300).cast("double").alias("w_end"), (price % 7).cast("double").alias("extra"))
    return routes.hill_factors(pieces, windows, "route", 0.25).select("route", "start", "end", F.round(1e6 * F.col("factor")).cast("long").alias("factor_ppm"))


@query(
    """WITH o AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS route_m, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 11 + 2) // 12 AS direct_m FROM orders)
    SELECT CASE WHEN direct_m <= 0 OR route_m <= greatest(direct_m * 1.25, direct_m + 0.33 * 1609.344) THEN NULL WHEN route_m > direct_m * 2 THEN 'strong' WHEN route_m > direct_m * 1.5 THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM o GROUP BY 1"""
)
def detour_levels(spark, sf_dir):
    route = F.floor("o_totalprice")
    direct = F.floor(route * (F.col("o_orderkey") % 11 + 2) / 12)
    return table(spark, sf_dir, "orders").groupBy(routes.detour_level(route, direct).alias("level")).agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT (p_size - 25) / 200.0 AS grade, CAST(p_partkey % 300 AS DOUBLE) AS climbed FROM part), f AS (SELECT *, greatest(1 / (1 + 12 * (grade - 0.01)), 0.3) AS slow, greatest(1 / (1 + 5 * (-grade - 0.04)), 0.6) AS spaced FROM g)
    SELECT CAST(round(1000 * grade) AS BIGINT) AS permille, CAST(sum(CAST(round(1e6 * CASE WHEN grade > 0.01 THEN 1 - (1 - slow) * least(1, climbed / 150) WHEN grade < -0.04 THEN spaced ELSE 1 END) AS BIGINT)) AS BIGINT) AS ppm FROM f GROUP BY 1"""
)
def grade_factors(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(((F.col("p_size") - 25) / 200.0).alias("grade"), (F.col("p_partkey") % 300).cast("double").alias("climbed"))
    return p.groupBy(F.round(1000 * F.col("grade")).cast("long").alias("permille")).agg(F.sum(F.round(1e6 * routes.grade_factor(F.col("grade"), F.col("climbed"))).cast("long")).alias("ppm"))


@query(
    f"""WITH {SAMPLES}, a AS (SELECT *, CASE WHEN value < 20 THEN 'a' WHEN value < 60 THEN 'b' WHEN value < 90 THEN 'c' END AS area FROM s),
    n AS (SELECT *, CASE WHEN area IS NOT DISTINCT FROM lag(area) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM a WINDOW w AS (PARTITION BY route ORDER BY along)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY route ORDER BY along) AS run FROM n)
    SELECT route, area, min(along) AS start, max(along) AS end, bool_or(event_type = 'purchase') AS kept FROM r GROUP BY route, run, area HAVING area IS NOT NULL AND (bool_or(event_type = 'purchase') OR max(along) - min(along) >= 0.1 * 1609.344)"""
)
def area_crossings(spark, sf_dir):
    area = F.when(F.col("value") < 20, "a").when(F.col("value") < 60, "b").when(F.col("value") < 90, "c")
    marked = samples(spark, sf_dir).withColumns({"area": area, "keep": F.col("event_type") == "purchase"})
    return routes.crossings(marked, "route", "along", "along", "area", "keep")


@query()
def simplified_lines(spark, sf_dir):
    return routes.simplify(samples(spark, sf_dir).select("route", "along", "x", "y"), "route", "along", "x", "y", 60.0)


@query()
def encoded_lines(spark, sf_dir):
    s = samples(spark, sf_dir).withColumns({"lon": F.col("x") / 1000 - 77, "lat": F.col("y") / 1000 + 38.9})
    return routes.polylines(s, "route", "along", "lon", "lat")
