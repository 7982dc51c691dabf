"""Conditional tags, and networks of ways: their vertices, pieces, spurs and links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.functions import conditions, stress
from roadweave.operators import network
from roadweave.plans.registry import query
from roadweave.session import table

VALUES = [
    ("no @ (Mo-Fr 07:00-10:00,16:00-19:00)", "weekday_rush"), ("no @ (Sa 07:00 - Su 18:00)", "weekend"), ("no @ (20:00-07:00); no @ (Sa-Su)", "weekend,night"), ("no @ (sunset-sunrise)", ""),
    ("yes @ (Mo-Fr)", ""), ("no @ (Mo-Fr 10:00-21:00)", "weekday_offpeak"), ("no @ (Mo-Su)", "weekend,weekday_rush,weekday_offpeak,night"), (None, ""),
]


@query(
    f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}')" for i, (_, s) in enumerate(VALUES))}) v(i, s)),
    t AS (SELECT p_size % 8 AS i, p_partkey % 3 AS j FROM part)
    SELECT CASE j WHEN 0 THEN 'secondary' WHEN 1 THEN 'path' ELSE 'tertiary' END AS highway, CASE WHEN j = 1 THEN '' ELSE s END AS settings, count(*) AS ways FROM t JOIN v USING (i) GROUP BY 1, 2"""
)
def car_free_settings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    value = F.get(F.array(*[F.lit(v) for v, _ in VALUES]), (F.col("p_size") % 8).cast("int"))
    highway = F.get(F.array(F.lit("secondary"), F.lit("path"), F.lit("tertiary")), (F.col("p_partkey") % 3).cast("int"))
    # each pair of values is read once
    pairs = p.groupBy(highway.alias("highway"), value.alias("value")).agg(F.count("*").alias("n"))
    tags = F.map_filter(F.create_map(F.lit("highway"), F.col("highway"), F.lit("motor_vehicle:conditional"), F.col("value")), lambda _, v: v.isNotNull())
    settings = pairs.select("highway", F.array_join(conditions.car_free_settings(tags), ",").alias("settings"), "n")
    return settings.groupBy("highway", "settings").agg(F.sum("n").alias("ways"))


def grid(spark, sf_dir):
    """Orders as edges of a grid of customers: every order an edge from its customer's node to one near it."""
    o = table(spark, sf_dir, "orders")
    u = F.col("o_custkey")
    return o.select(F.col("o_orderkey").alias("row"), u.alias("u"), (u + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(100)).alias("v"), (10.0 + F.col("o_orderkey") % 50).alias("cost"))


@query()
def network_links(spark, sf_dir):
    """The edges that join pieces of the network which reach a size together."""
    edges = grid(spark, sf_dir)
    inside = edges.where("row % 5 = 0")
    pieces = network.pieces(inside)
    return network.connected(edges.where("row % 5 != 0"), pieces, inside, 120.0, 200.0)


@query()
def network_spurs(spark, sf_dir):
    return network.spurs(grid(spark, sf_dir).where("row % 4 = 0"), 60.0)


@query(
    """WITH p AS (SELECT l_orderkey AS line, l_linenumber AS n, l_suppkey * 31 % 997 AS node, 5.0 + l_partkey % 20 AS step, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS last FROM lineitem),
    s AS (SELECT node FROM p GROUP BY 1 HAVING count(DISTINCT line) > 3),
    a AS (SELECT *, sum(CASE WHEN i = 1 THEN 0 ELSE step END) OVER (PARTITION BY line ORDER BY i ROWS UNBOUNDED PRECEDING) AS along FROM p)
    SELECT line, i, node, along FROM a WHERE i = 1 OR i = last OR node IN (SELECT node FROM s)"""
)
def network_vertices(spark, sf_dir):
    """Ends of lines, and vertices that more than three lines share, with the distance along the line."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.row_number().over(w).cast("long").alias("i"), (F.col("l_suppkey") * 31 % 997).alias("node"), (5.0 + F.col("l_partkey") % 20).alias("step"))
    return network.vertices(points, 4)


ROADS = ("primary", "secondary", "tertiary", "residential", "path", "motorway")


@query(
    f"""WITH t AS (SELECT p_partkey AS k, (['{"', '".join(ROADS)}'])[p_partkey % 6 + 1] AS highway, CASE WHEN p_partkey % 4 > 0 THEN 15 + p_partkey % 9 * 5 END AS posted, CASE WHEN p_partkey % 5 > 0 THEN p_size % 7 + 1 END AS lanes,
        p_partkey % 3 = 0 AS urban, p_partkey % 7 = 0 AS dc, p_partkey % 11 = 0 AS oneway, p_partkey % 2 = 0 AS lane, CASE WHEN p_partkey % 8 = 0 THEN 2.0 WHEN p_partkey % 8 = 2 THEN 1.5 END AS width FROM part),
    m AS (
        SELECT *, coalesce(posted, CASE WHEN dc THEN 20 END, CASE highway WHEN 'primary' THEN CASE WHEN urban THEN 35 ELSE 55 END WHEN 'secondary' THEN CASE WHEN urban THEN 35 ELSE 50 END WHEN 'tertiary' THEN CASE WHEN urban THEN 30 ELSE 45 END
            WHEN 'residential' THEN CASE WHEN urban THEN 25 ELSE 30 END WHEN 'path' THEN CASE WHEN urban THEN 30 ELSE 35 END ELSE CASE WHEN urban THEN 30 ELSE 35 END END) AS mph,
            coalesce(greatest(1, CASE WHEN oneway THEN lanes ELSE lanes // 2 END) + 0 * lanes, 1) AS n FROM t),
    r AS (SELECT *, least(CASE WHEN oneway AND n <= 2 THEN 1 ELSE n END, 3) AS rw, 1 + (mph > 20)::INT + (mph > 25)::INT + (mph > 30)::INT + (mph > 35)::INT + (mph > 40)::INT + (mph > 45)::INT AS c FROM m),
    v AS (
        SELECT *, ([[1, 1, 2, 2, 3, 3, 4], [3, 3, 3, 3, 4, 4, 4], [3, 3, 4, 4, 4, 4, 4]])[rw][c] AS mixed,
            CASE WHEN width >= 6 * 0.3048 THEN ([[1, 1, 1, 2, 3, 3, 3], [2, 2, 2, 2, 3, 3, 3], [3, 3, 3, 4, 4, 4, 4]])[rw][c] ELSE ([[2, 2, 2, 2, 3, 3, 4], [2, 2, 2, 2, 3, 3, 4], [3, 3, 3, 4, 4, 4, 4]])[rw][c] END AS painted FROM r)
    SELECT highway, CASE WHEN highway = 'path' THEN 1 WHEN highway = 'motorway' THEN 4 WHEN lane THEN CASE WHEN (NOT oneway AND n >= 2) OR (oneway AND n >= 3) THEN greatest(painted, 3) ELSE painted END ELSE mixed END AS level,
        CASE WHEN highway = 'path' THEN 'trail' WHEN highway = 'motorway' THEN 'motorway' WHEN lane THEN 'lane' ELSE 'mixed' END AS rule, count(*) AS ways FROM v GROUP BY ALL"""
)
def base_levels(spark, sf_dir):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    pairs = {
        "highway": F.get(F.array(*map(F.lit, ROADS)), (k % 6).cast("int")), "maxspeed": F.when(k % 4 > 0, text(15 + k % 9 * 5)), "lanes": F.when(k % 5 > 0, text(F.col("p_size") % 7 + 1)),
        "oneway": F.when(k % 11 == 0, "yes"), "cycleway": F.when(k % 2 == 0, "lane"), "cycleway:width": F.when(k % 8 == 0, "2").when(k % 8 == 2, "1.5"),
    }
    tags = F.map_filter(F.create_map(*[c for key, v in pairs.items() for c in (F.lit(key), v)]), lambda _, v: v.isNotNull())
    # dealt anew: a small file is few tasks, and reading tags is the work
    p = table(spark, sf_dir, "part").repartition("p_partkey").select(tags.alias("tags"), F.when(k % 7 == 0, "DC").alias("state"), (k % 3 == 0).alias("urban"))
    of = p.select(F.col("tags")["highway"].alias("highway"), stress.base_level(F.col("tags"), F.col("state"), F.col("urban")).alias("b"))
    return of.groupBy("highway", "b.level", "b.rule").agg(F.count("*").alias("ways"))
