"""Conflation, levels and whole-network queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.operators import conflation
from roadweave.plans.registry import query
from roadweave.session import dealt, table


@query()
def exclusive_claims(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("way"), F.col("l_suppkey").alias("feature"), (F.col("l_partkey") % 3).cast("int").alias("precedence"),
        (F.col("l_quantity") / 50).alias("share"), (F.col("l_partkey") * 37 % 1000).cast("double").alias("lo"), F.col("l_discount").alias("apart"),
    )
    # hi follows lo, so it isn't shuffled
    least = dealt(line, "way", "feature").groupBy("way", "feature").agg(F.min(F.struct("precedence", "share", "lo", "apart")).alias("m")).select("way", "feature", "m.*")
    return conflation.claim(least.select("way", "feature", "precedence", "share", "lo", (F.col("lo") + 90).alias("hi"), "apart"))


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS way, l_suppkey % 3 AS agency, l_partkey AS record, l_quantity / 50 AS share, 40.0 * l_linenumber AS length, l_partkey % 5 AS level, l_partkey % 4 = 0 AS ban FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY way, agency ORDER BY share DESC, record, length, level) AS rn, min_by(record, (-share, record)) OVER (PARTITION BY way, agency) AS fr, max(share) OVER (PARTITION BY way, agency) AS fs FROM s),
    may AS (SELECT *, record = fr AND share = fs AS is_first FROM f WHERE (record = fr AND share = fs) OR (NOT ban AND (share * length >= 160 OR share >= 0.5))),
    r AS (SELECT way, agency, record, level, row_number() OVER (PARTITION BY way, agency ORDER BY (is_first AND ban)::INT DESC, level DESC, share DESC, record) AS k FROM may)
    SELECT way, agency, record, level FROM r WHERE k = 1"""
)
def worst_rating(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("way"), (F.col("l_suppkey") % 3).alias("agency"), F.col("l_partkey").alias("record"), (F.col("l_quantity") / 50).alias("share"),
        (40.0 * F.col("l_linenumber")).alias("length"), (F.col("l_partkey") % 5).alias("level"), (F.col("l_partkey") % 4 == 0).alias("ban"),
    )
    return conflation.worst_rating(s.distinct())


@query()
def small_loops(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return conflation.small_loops(o.select(k.alias("way"), (F.floor(k / 3)).alias("name"), (k % 3).alias("a"), ((k + 1) % 3).alias("b"), (20 + k % 50).cast("double").alias("length")), 130)


@query()
def through_networks(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), (1000000 + F.col("l_partkey") % 97).alias("node"), F.when(F.col("l_returnflag") == "R", "gate").alias("reason"))
    return conflation.through_networks(line, line.where("node % 3 = 0").select("node"))


@query(
    """WITH p AS (SELECT least(o_custkey % 40, o_orderkey % 40) AS i, greatest(o_custkey % 40, o_orderkey % 40) AS j FROM orders) SELECT i, j, count(*) AS trips, CASE WHEN count(*) >= 200 THEN 3 WHEN count(*) >= 75 THEN 2 WHEN count(*) >= 25 THEN 1 ELSE 0 END AS popular FROM p WHERE i <> j GROUP BY 1, 2"""
)
def trip_pairs(spark, sf_dir):
    """Trips between docks, either way, and their class."""
    a, b = F.col("o_custkey") % 40, F.col("o_orderkey") % 40
    n = table(spark, sf_dir, "orders").select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).where("i != j").groupBy("i", "j").agg(F.count("*").alias("trips"))
    t = F.col("trips")
    return n.withColumn("popular", F.when(t >= 200, 3).when(t >= 75, 2).when(t >= 25, 1).otherwise(0))


@query(
    """WITH r AS (SELECT p_partkey, CAST(1 + p_size % 4 AS DOUBLE) AS base, CASE p_size % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'trunk' ELSE 'residential' END AS road,
        CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 97 % 24000 END AS n, 15 + p_partkey % 9 * 5 AS speed, p_partkey % 2 = 0 AS posted, p_partkey % 7 = 0 AS facility, CASE p_partkey % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'private' END AS access,
        p_partkey % 13 = 0 AS rough, p_partkey % 4 = 0 AS expressway, p_partkey % 5 < 3 AS urban, 1 + p_partkey % 2 AS lanes FROM part),
    a AS (SELECT *, CASE WHEN NOT facility AND lanes <= 1 AND n <= 1500 AND (NOT posted OR speed <= 35) THEN greatest(base - 1, 1.0) WHEN NOT facility AND lanes <= 1 AND n >= 8000 THEN least(base + 1, 4.0) WHEN NOT facility AND lanes <= 1 AND n > 1500 AND speed <= 20 AND base = 1 THEN 2.0 ELSE base END AS t FROM r),
    b AS (SELECT * REPLACE (CASE WHEN NOT facility THEN greatest(t, CASE WHEN road IN ('trunk', 'primary', 'secondary') THEN 3.0 WHEN road = 'tertiary' THEN 2.0 ELSE 1.0 END) ELSE t END AS t) FROM a),
    c AS (SELECT * REPLACE (CASE WHEN access IS NOT NULL AND n IS NULL THEN least(t, CASE access WHEN 'no' THEN 1.0 ELSE 2.0 END + CASE WHEN posted AND speed > 30 THEN 1.0 ELSE 0.0 END) ELSE t END AS t) FROM b),
    d AS (SELECT * REPLACE (CASE WHEN rough AND t = 1 THEN 2.0 ELSE t END AS t) FROM c),
    e AS (SELECT * REPLACE (CASE WHEN urban AND NOT facility AND t = 3 AND n >= 20000 THEN 4.0 WHEN urban AND NOT facility AND t = 3 AND n >= 12000 THEN 3.5 WHEN NOT urban AND NOT facility AND lanes <= 1 AND road IN ('primary', 'trunk') AND t = 4 AND n >= 18000 THEN 4.5 ELSE t END AS t) FROM d)
    SELECT road, CAST(CASE WHEN expressway AND posted AND speed >= 50 AND road IN ('trunk', 'primary') THEN CASE WHEN urban THEN 5.0 ELSE 4.5 END ELSE t END AS DOUBLE) AS level, count(*) AS n FROM e GROUP BY 1, 2"""
)
def stress_levels(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    road = F.when(size % 5 == 0, "primary").when(size % 5 == 1, "secondary").when(size % 5 == 2, "tertiary").when(size % 5 == 3, "trunk").otherwise("residential")
    level = conflation.tier_steps(
        1 + size % 4, road, F.when(k % 3 > 0, k * 97 % 24000), 15 + k % 9 * 5, k % 2 == 0, k % 7 == 0, F.when(k % 11 == 0, "no").when(k % 11 == 1, "private"), k % 13 == 0, k % 4 == 0, k % 5 < 3, 1 + k % 2
    )
    return table(spark, sf_dir, "part").groupBy(road.alias("road"), level.alias("level")).agg(F.count("*").alias("n"))
