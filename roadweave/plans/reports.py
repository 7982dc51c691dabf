"""Reports on built segments: shares of known roads, tiers of a street, lengths by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.operators import layers
from roadweave.operators.conflation import candidates
from roadweave.plans.layered import SEGMENTS, segments
from roadweave.plans.registry import query
from roadweave.session import table


@query(
    f"""WITH {SEGMENTS}, e AS (SELECT DISTINCT name, CAST(substr(name, 7) AS INTEGER) % 5 + 1 AS want, CAST(substr(name, 7) AS INTEGER) % 2 = 0 AS at_least FROM g WHERE name IS NOT NULL)
    SELECT e.name, want, at_least, CAST(sum(length) AS BIGINT) AS total, CAST(coalesce(sum(length) FILTER (WHERE CASE WHEN at_least THEN tier >= want ELSE tier = want END), 0) AS BIGINT) AS held,
        CASE WHEN sum(length) < 500 THEN 'unread' WHEN coalesce(sum(length) FILTER (WHERE CASE WHEN at_least THEN tier >= want ELSE tier = want END), 0) >= 0.25 * sum(length) THEN 'ok' ELSE 'off' END AS state
    FROM e JOIN g USING (name) GROUP BY ALL"""
)
def known_road_shares(spark, sf_dir):
    s = segments(spark, sf_dir)
    number = F.substring("name", 7, 9).cast("int")
    expected = s.select("name").distinct().where("name IS NOT NULL").select("name", (number % 5 + 1).alias("want"), (number % 2 == 0).alias("at_least"))
    return layers.level_share(s.select("name", F.col("tier").alias("level"), "length"), expected, "name", 0.25, 500)


@query(
    f"""WITH {SEGMENTS} SELECT name, CAST(sum(length) AS BIGINT) AS total, CAST(coalesce(sum(length) FILTER (WHERE tier = 4), 0) AS BIGINT) AS busiest, CAST(coalesce(sum(length) FILTER (WHERE way % 2 = 0), 0) AS BIGINT) AS north,
        CAST(coalesce(sum(length) FILTER (WHERE tier = 4 AND way % 2 = 0), 0) AS BIGINT) AS north_busiest FROM g GROUP BY name"""
)
def street_tiers(spark, sf_dir):
    north, busiest = F.col("way") % 2 == 0, F.col("tier") == 4
    return layers.held_lengths(segments(spark, sf_dir), ["name"], "length", busiest=busiest, north=north, north_busiest=busiest & north)


@query(f"WITH {SEGMENTS} SELECT facility, tier, count(*) AS n, CAST(sum(length) AS BIGINT) AS length FROM g WHERE bridge > 0 GROUP BY ALL")
def lengths_by_class(spark, sf_dir):
    return layers.counted_lengths(segments(spark, sf_dir).where("bridge > 0"), ["facility", "tier"], "length")


# Ways and features share streets of points 10 apart; each has five points, and an offset across.
@query(
    """WITH w AS (SELECT c_custkey AS way, (c_custkey % 97) * 40.0 + i * 10 AS x, (c_custkey // 97) * 50.0 AS y, (c_custkey % 4) * 20.0 AS h FROM customer, range(5) t(i)),
    f AS (SELECT s_suppkey AS feature, (s_suppkey * 7 % 97) * 40.0 + i * 10 + 3 AS fx, (s_suppkey * 7 // 97) * 50.0 + s_suppkey % 3 * 4 AS fy, (s_suppkey % 5) * 45.0 AS fh, i * 10.0 AS along FROM supplier, range(5) t(i)),
    p AS (SELECT *, (x - fx) * (x - fx) + (y - fy) * (y - fy) AS d2, abs(h - fh) % 180 AS turn FROM w JOIN f ON abs(x - fx) <= 20 AND abs(y - fy) <= 20),
    b AS (SELECT way, feature, x, y, min(d2) AS d2, min_by(along, (d2, along)) AS along FROM p WHERE d2 <= 400 AND least(turn, 180 - turn) <= 25 GROUP BY 1, 2, 3, 4)
    SELECT way, feature, count(*) / 5 AS share, min(along) AS lo, max(along) AS hi, round(avg(sqrt(d2)), 6) AS apart FROM b GROUP BY 1, 2 HAVING count(*) / 5 >= 0.5"""
)
def line_matches(spark, sf_dir):
    i, c, s = F.col("i"), F.col("c_custkey"), F.col("s_suppkey")
    steps = F.explode(F.array(*[F.lit(n) for n in range(5)])).alias("i")
    ways = table(spark, sf_dir, "customer").select("c_custkey", steps).select(
        c.alias("way"), (c % 97 * 40.0 + i * 10).alias("x"), (F.floor(c / 97) * 50.0).alias("y"), (c % 4 * 20.0).alias("heading")
    )
    features = table(spark, sf_dir, "supplier").select("s_suppkey", steps).select(
        s.alias("feature"), (s * 7 % 97 * 40.0 + i * 10 + 3).alias("fx"), (F.floor(s * 7 / 97) * 50.0 + s % 3 * 4).alias("fy"), (s % 5 * 45.0).alias("fheading"), (i * 10.0).alias("along")
    )
    return candidates(ways, features).withColumn("apart", F.round("apart", 6))
