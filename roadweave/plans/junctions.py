"""Queries of junctions: lines of orders are junctions that a route passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.functions import junctions as read
from roadweave.plans.registry import query
from roadweave.session import table

CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", None)


def sql_rank(n: str) -> str:
    """SQL of a class number's rank: numbers are the place in CLASSES, 7 and 8 are no roads."""
    return f"CASE WHEN {n} < 7 THEN {n} ELSE 7 END"


def sql_stop(rank: str) -> str:
    return f"CASE WHEN {rank} <= 2 THEN 30.0 WHEN {rank} = 3 THEN 20.0 WHEN {rank} = 4 THEN 12.0 WHEN rolls THEN 4.0 ELSE 8.0 END"


@query(
    f"""WITH j AS (SELECT l_partkey % 9 AS a, l_suppkey % 9 AS b, list_filter([l_orderkey % 9, l_quantity::BIGINT % 9, l_linenumber % 9], lambda r: r < 7) AS arms, l_orderkey % 5 = 0 AS path, l_partkey % 7 = 0 AS onto_path,
            l_orderkey % 11 = 0 AS signal, l_linenumber % 2 = 0 AS ahead, l_partkey % 4 = 0 AS one, l_suppkey % 2 = 0 AS crossed, l_linenumber % 3 = 0 AS rolls FROM lineitem),
    r AS (SELECT *, {sql_rank('a')} AS own, CASE WHEN onto_path THEN 7 ELSE {sql_rank('b')} END AS onto, list_filter(arms, lambda r: r <= {sql_rank('a')}) AS met FROM j),
    s AS (SELECT *, least(onto, list_min(arms)) AS low, list_min(met) AS low_met FROM r)
    SELECT path, own, CAST(CASE WHEN signal THEN 15.0 WHEN len(arms) = 0 THEN CASE WHEN path AND onto < 7 THEN {sql_stop('onto')} ELSE 0.0 END WHEN path THEN {sql_stop('low')}
        WHEN ahead AND (one OR a = b) THEN CASE WHEN len(met) >= 2 THEN {sql_stop('low_met')} ELSE 0.0 END WHEN onto > own OR (onto = own AND NOT crossed) THEN 0.0 ELSE {sql_stop('low')} END AS DOUBLE) AS seconds, count(*) AS n
    FROM s GROUP BY ALL"""
)
def junction_delays(spark, sf_dir):
    part, supp, order, number = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    road = lambda n: F.get(F.array(*[F.lit(c).cast("string") for c in CLASSES]), (n % 9).cast("int"))
    arms = F.array(road(order), road(F.col("l_quantity").cast("long")), road(number))
    seconds = read.junction_delay_s(order % 5 == 0, part % 7 == 0, road(part), road(supp), arms, order % 11 == 0, number % 2 == 0, part % 4 == 0, supp % 2 == 0, number % 3 == 0)
    return table(spark, sf_dir, "lineitem").groupBy((order % 5 == 0).alias("path"), read.road_rank(road(part)).cast("long").alias("own"), seconds.alias("seconds")).agg(F.count("*").alias("n"))
