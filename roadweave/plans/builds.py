"""Build-to-build reports, layered overrides and conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.operators.joins import changed, distinct_on, unpaired
from roadweave.plans.registry import query
from roadweave.session import dealt, table

BUILDS = """
    live AS (SELECT l_orderkey AS way, l_linenumber AS ordinal, CAST(max(l_quantity) AS BIGINT) AS grade FROM lineitem WHERE l_partkey % 10 < 9 GROUP BY 1, 2),
    retired AS (SELECT l_orderkey AS way, l_linenumber AS ordinal, CAST(max(l_quantity) AS BIGINT) AS grade FROM lineitem WHERE l_partkey % 10 > 0 GROUP BY 1, 2)"""


def builds(spark, sf_dir):
    """Two builds of a segment table: natural key (way, ordinal) and a grade."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("ordinal"), "l_partkey", "l_quantity")
    line = dealt(line, "way", "ordinal")
    build = lambda keep: line.where(keep).groupBy("way", "ordinal").agg(F.max("l_quantity").cast("long").alias("grade"))
    return build(F.col("l_partkey") % 10 < 9), build(F.col("l_partkey") % 10 > 0)


@query(
    f"""WITH {BUILDS}
    SELECT count(*) FILTER (live.way IS NULL) AS lost, count(*) FILTER (retired.way IS NULL) AS added,
           count(*) FILTER (live.grade <> retired.grade) AS regraded, count(*) AS compared
    FROM live FULL OUTER JOIN retired ON live.way = retired.way AND live.ordinal = retired.ordinal"""
)
def drift_full_outer(spark, sf_dir):
    live, retired = builds(spark, sf_dir)
    both = live.withColumnRenamed("grade", "live").join(retired.withColumnRenamed("grade", "retired"), ["way", "ordinal"], "full_outer")
    return both.agg(
        F.count_if(F.col("live").isNull()).alias("lost"),
        F.count_if(F.col("retired").isNull()).alias("added"),
        F.count_if(F.col("live") != F.col("retired")).alias("regraded"),
        F.count("*").alias("compared"),
    )


@query(
    f"""WITH {BUILDS}
    SELECT n_name AS area, count(*) AS changed, count(*) FILTER (live.grade > retired.grade) AS raised, CAST(sum(live.grade - retired.grade) AS BIGINT) AS by
    FROM live JOIN retired USING (way, ordinal) JOIN orders ON way = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE live.grade IS DISTINCT FROM retired.grade GROUP BY 1"""
)
def changes_by_area(spark, sf_dir):
    live, retired = builds(spark, sf_dir)
    both = live.withColumnRenamed("grade", "now").join(retired.withColumnRenamed("grade", "was"), ["way", "ordinal"]).where(changed(F.col("now"), F.col("was")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way"), F.col("o_custkey").alias("c_custkey"))
    area = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(table(spark, sf_dir, "nation"), "n_nationkey")
    placed = both.join(orders, "way").join(area, "c_custkey")
    return placed.groupBy(F.col("n_name").alias("area")).agg(F.count("*").alias("changed"), F.count_if(F.col("now") > F.col("was")).alias("raised"), F.sum(F.col("now") - F.col("was")).alias("by"))


@query(
    f"""WITH {BUILDS}
    SELECT way, ordinal, grade, 'added' AS side FROM live WHERE NOT EXISTS (SELECT 1 FROM retired r WHERE r.way = live.way AND r.ordinal = live.ordinal)
    UNION ALL SELECT way, ordinal, grade, 'lost' FROM retired WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.way = retired.way AND l.ordinal = retired.ordinal)"""
)
def unpaired_rows(spark, sf_dir):
    added, lost = unpaired(*builds(spark, sf_dir), ["way", "ordinal"])
    return added.select("way", "ordinal", "grade", F.lit("added").alias("side")).unionByName(lost.select("way", "ordinal", "grade", F.lit("lost").alias("side")))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def distinct_on_latest(spark, sf_dir):
    return distinct_on(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(
    """SELECT l_returnflag, l_linestatus, count(*) FILTER (l_quantity >= 25) AS wide, CAST(min(l_partkey) FILTER (l_quantity >= 25) AS BIGINT) AS low,
        CAST(max(l_partkey) FILTER (l_quantity < 25) AS BIGINT) AS high, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) FILTER (l_discount > 0.02) AS middle
    FROM lineitem GROUP BY 1, 2"""
)
def filter_aggs(spark, sf_dir):
    wide = F.col("l_quantity") >= 25
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(wide).alias("wide"),
        F.min(F.when(wide, F.col("l_partkey"))).alias("low"),
        F.max(F.when(~wide, F.col("l_partkey"))).alias("high"),
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) FILTER (WHERE l_discount > 0.02)").alias("middle"),
    )


@query("SELECT c_nationkey, count(*) AS n, md5(string_agg(CAST(c_custkey AS VARCHAR) || ':' || c_mktsegment, ',' ORDER BY c_custkey)) AS digest FROM customer GROUP BY 1")
def digest_agg(spark, sf_dir):
    entry = F.struct("c_custkey", F.concat_ws(":", F.col("c_custkey").cast("string"), "c_mktsegment").alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["t"])
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.md5(F.array_join(texts, ",")).alias("digest"))


@query(
    """WITH tiers AS (SELECT l_partkey, 1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS tier FROM lineitem),
    rules AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size % 5 + 1 END AS exact, CASE WHEN p_size % 3 = 1 THEN p_size % 5 + 1 END AS at_least FROM part WHERE p_size <= 30)
    SELECT tier AS before, coalesce(exact, greatest(tier, at_least), tier) AS after, count(*) AS n FROM tiers LEFT JOIN rules ON l_partkey = p_partkey GROUP BY 1, 2"""
)
def override_layer(spark, sf_dir):
    """An exact override wins, a floor lifts, all else keeps its tier."""
    tiers = table(spark, sf_dir, "lineitem").select("l_partkey", (1 + F.floor("l_quantity") % 5).alias("tier"))
    size = F.col("p_size")
    rules = table(spark, sf_dir, "part").where(size <= 30).select(F.col("p_partkey").alias("l_partkey"), F.when(size % 3 == 0, size % 5 + 1).alias("exact"), F.when(size % 3 == 1, size % 5 + 1).alias("at_least"))
    after = F.coalesce("exact", F.greatest("tier", "at_least"), "tier").cast("long")
    return tiers.join(rules, "l_partkey", "left").groupBy(F.col("tier").alias("before"), after.alias("after")).agg(F.count("*").alias("n"))


@query(
    """WITH grouped AS (SELECT s_nationkey, list(s_suppkey) AS ways FROM supplier GROUP BY 1),
    rows AS (SELECT s_suppkey AS way, 'access' AS kind FROM supplier WHERE s_acctbal > 0 UNION SELECT unnest(ways), 'access' FROM grouped WHERE s_nationkey % 2 = 0),
    retired AS (SELECT s_suppkey AS way, 'access' AS kind, max(s_acctbal) FROM supplier WHERE s_suppkey % 7 = 0 GROUP BY 1)
    SELECT way, kind FROM rows WHERE NOT EXISTS (SELECT 1 FROM retired r WHERE r.way = rows.way AND r.kind = rows.kind)"""
)
def override_dedupe(spark, sf_dir):
    """Rows, one row per way of each group, without what a later file retires."""
    s = table(spark, sf_dir, "supplier").withColumn("kind", F.lit("access"))
    rows = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("way"), "kind")
    groups = s.groupBy("s_nationkey", "kind").agg(F.collect_list("s_suppkey").alias("ways")).where("s_nationkey % 2 = 0").select(F.explode("ways").alias("way"), "kind")
    retired = s.where("s_suppkey % 7 = 0").groupBy(F.col("s_suppkey").alias("way"), "kind").agg(F.max("s_acctbal"))
    return rows.unionByName(groups).distinct().join(retired, ["way", "kind"], "left_anti").select("way", "kind")


def compare_bucket(theirs, ours):
    d = theirs - ours
    return F.when(d >= 2, "agency_much_higher").when(d > 0, "agency_higher").when(d == 0, "same").when(d > -2, "ours_higher").otherwise("ours_much_higher")


@query(
    """WITH b AS (SELECT l_returnflag AS agency, CAST(l_quantity AS BIGINT) AS m, (l_partkey % 8 + 2) / 2.0 - (l_suppkey % 8 + 2) / 2.0 AS d FROM lineitem),
    named AS (SELECT agency, m, CASE WHEN d >= 2 THEN 'agency_much_higher' WHEN d > 0 THEN 'agency_higher' WHEN d = 0 THEN 'same' WHEN d > -2 THEN 'ours_higher' ELSE 'ours_much_higher' END AS bucket FROM b)
    SELECT agency, bucket, CAST(sum(m) AS BIGINT) AS metres, CAST(floor(1000 * sum(m) / sum(sum(m)) OVER (PARTITION BY agency)) AS BIGINT) AS permille FROM named GROUP BY 1, 2"""
)
def compare_buckets(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    level = lambda c: (F.col(c) % 8 + 2) / 2.0
    sums = line.groupBy(F.col("l_returnflag").alias("agency"), compare_bucket(level("l_partkey"), level("l_suppkey")).alias("bucket")).agg(F.sum(F.col("l_quantity").cast("long")).alias("metres"))
    return sums.withColumn("permille", F.floor(1000 * F.col("metres") / F.sum("metres").over(Window.partitionBy("agency"))).cast("long"))


@query(
    """WITH a AS (SELECT c_mktsegment AS input, count(*) AS n FROM customer WHERE c_nationkey < 20 GROUP BY 1), b AS (SELECT c_mktsegment AS input, count(*) AS n FROM customer WHERE c_custkey % 3 > 0 AND c_nationkey > 0 GROUP BY 1)
    SELECT coalesce(a.input, b.input) AS input, a.n AS recorded, b.n AS measured FROM a FULL OUTER JOIN b ON a.input = b.input WHERE a.n IS DISTINCT FROM b.n"""
)
def changed_inputs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    of = lambda keep, name: c.where(keep).groupBy(F.col("c_mktsegment").alias("input")).agg(F.count("*").alias(name))
    both = of("c_nationkey < 20", "recorded").join(of("c_custkey % 3 > 0 and c_nationkey > 0", "measured"), "input", "full_outer")
    return both.where(changed(F.col("recorded"), F.col("measured"))).select("input", "recorded", "measured")


@query(
    """WITH rows AS (SELECT l_orderkey AS way, bool_or(l_discount > 0.05) AS busy, count(DISTINCT l_suppkey) AS raters, CAST(sum(l_quantity) AS BIGINT) AS metres, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS unpaved FROM lineitem GROUP BY 1)
    SELECT way, busy, raters, metres, CAST(floor(1000 * unpaved / nullif(metres, 0)) AS BIGINT) AS unpaved_permille FROM rows"""
)
def way_traits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(
        F.bool_or(F.col("l_discount") > 0.05).alias("busy"),
        F.countDistinct("l_suppkey").alias("raters"),
        F.sum("l_quantity").cast("long").alias("metres"),
        F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))), F.lit(0)).cast("long").alias("unpaved"),
    )
    share = F.floor(1000 * F.col("unpaved") / F.nullif("metres", F.lit(0))).cast("long")
    return rows.select("way", "busy", "raters", "metres", share.alias("unpaved_permille"))


@query(
    """WITH ends AS (SELECT l_orderkey AS way, arg_min(l_partkey, (l_linenumber, l_partkey)) AS first, arg_max(l_partkey, (l_linenumber, l_partkey)) AS last FROM lineitem GROUP BY 1) SELECT way, first, last FROM ends WHERE first <> last"""
)
def way_ends(spark, sf_dir):
    order = F.struct("l_linenumber", "l_partkey")
    ends = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way")).agg(F.min_by("l_partkey", order).alias("first"), F.max_by("l_partkey", order).alias("last"))
    return ends.where("first != last")


@query(
    """SELECT l_orderkey AS way, fact.field AS field, fact.ours AS ours, fact.theirs AS theirs, count(*) AS n FROM (
        SELECT l_orderkey, unnest([{'field': 'speed', 'ours': l_partkey % 5, 'theirs': l_suppkey % 5}, {'field': 'lanes', 'ours': l_partkey % 3, 'theirs': l_suppkey % 3}]) AS fact FROM lineitem)
    WHERE fact.ours IS DISTINCT FROM fact.theirs GROUP BY 1, 2, 3, 4"""
)
def discrepancy_items(spark, sf_dir):
    """Each way gives a record for each fact in which two sources differ."""
    line = table(spark, sf_dir, "lineitem")
    fact = lambda name, m: F.struct(F.lit(name).alias("field"), (F.col("l_partkey") % m).alias("ours"), (F.col("l_suppkey") % m).alias("theirs"))
    facts = F.filter(F.array(fact("speed", 5), fact("lanes", 3)), lambda x: changed(x["ours"], x["theirs"]))
    return line.select(F.col("l_orderkey").alias("way"), F.explode(facts).alias("f")).groupBy("way", "f.field", "f.ours", "f.theirs").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS way, l_linenumber AS ordinal, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """The natural key's check: rows that break it."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way"), F.col("l_linenumber").alias("ordinal")).agg(F.count("*").alias("n")).where("n > 1")


@query(
    """WITH t AS (SELECT p_brand, p_size % 3 = 0 AS agree FROM part) SELECT p_brand, count(*) FILTER (agree) AS agree, count(*) FILTER (NOT agree) AS disagree, bool_and(agree) AS every, bool_or(agree) AS some FROM t GROUP BY 1"""
)
def tallies(spark, sf_dir):
    agree = F.col("p_size") % 3 == 0
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(agree).alias("agree"), F.count_if(~agree).alias("disagree"), F.bool_and(agree).alias("every"), F.bool_or(agree).alias("some"))
