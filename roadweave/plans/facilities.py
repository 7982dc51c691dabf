"""Queries of facility, map class and access: ways are parts, their tags follow from the part's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.functions import facilities as read
from roadweave.plans.registry import query
from roadweave.plans.tagged import sql_tags, tagged

# Tags by the remainder of the part's key: (tag, divisor, values by remainder; None: no tag).
TAGS = (
    ("highway", 9, ("residential", "service", "motorway", "cycleway", "footway", "path", "corridor", "primary", None)),
    ("bicycle", 17, ("yes", "no", "designated", "private", "use_sidepath", "dismount", *[None] * 11)),
    ("access", 11, ("private", "no", "permissive", *[None] * 8)),
    ("vehicle", 13, ("permit", "yes", *[None] * 11)),
    ("service", 5, ("parking_aisle", "alley", "driveway", None, None)),
    ("motor_vehicle", 7, ("no", "no", *[None] * 5)),
    ("oneway", 4, ("yes", "-1", "no", None)),
    ("cycleway", 6, ("track", "lane", "opposite_lane", "sidewalk", None, None)),
    ("cycleway:left", 8, ("lane", "no", "buffered_lane", "track", *[None] * 4)),
    ("cycleway:right", 10, ("track", "lane", "opposite_track", "no", *[None] * 6)),
    ("cycleway:left:oneway", 7, ("-1", "yes", "no", *[None] * 4)),
    ("cycleway:oneway", 5, ("-1", "no", None, None, None)),
    ("cycleway:both:separation", 12, ("line;bollard", "dashed_line", *[None] * 10)),
    ("cycleway:left:width", 3, ("1.5", "2", None)),
    ("cycleway:width", 4, ("1.75", "wide", None, None)),
    ("footway", 9, ("sidewalk", "crossing", "traffic_island", *[None] * 6)),
    ("indoor", 14, ("yes", "no", *[None] * 12)),
    ("motorroad", 15, ("yes", *[None] * 14)),
    ("impassable", 16, ("yes", *[None] * 15)),
    ("name", 3, ("Creek Trail", "", None)),
    ("segregated", 8, ("yes", *[None] * 7)),
    ("foot", 6, ("yes", "no", *[None] * 4)),
    ("bicycle_road", 12, ("yes", "no", *[None] * 10)),
)


def sql_side(name: str) -> str:
    """SQL of one side: its word, rank, width, whether it is two-way and whether it runs against the traffic."""
    own, width, way = f'"cycleway:{name}"', '"cycleway:left:width"' if name == "left" else "NULL", '"cycleway:left:oneway"' if name == "left" else "NULL"
    word, runs = f"coalesce({own}, cycleway)", f"CASE WHEN {own} IS NOT NULL THEN {way} WHEN cycleway IS NOT NULL THEN \"cycleway:oneway\" END"
    rank = f"CASE WHEN {word} LIKE '%track' THEN 2 WHEN {word} LIKE '%lane' THEN 1 ELSE 0 END"
    return f"""{word} AS {name}_word, {rank} AS {name}_rank, CASE WHEN {word} IS NULL OR {rank} > 0 THEN coalesce(TRY_CAST({width} AS DOUBLE), TRY_CAST("cycleway:width" AS DOUBLE)) END AS {name}_wide,
        coalesce({runs} = 'no', false) AS {name}_two, coalesce({word} LIKE 'opposite%', false) OR coalesce((oneway = 'yes' AND {runs} = '-1') OR (oneway = '-1' AND {runs} = 'yes'), false) AS {name}_contra"""


# A direction is (rank, widest lane of that rank); lists of the sides that serve it, as structs.
SQL = f"""{sql_tags(TAGS)}, s AS (SELECT *, coalesce(oneway IN ('yes', '-1'), false) AS one, coalesce(highway IN ('cycleway', 'footway', 'path'), false) AS trail, coalesce(highway IN ('cycleway', 'path'), false) AS ours,
        coalesce(access IN ('private', 'no') OR vehicle = 'permit', false) AS shut, coalesce(bicycle IN ('yes', 'designated'), false) AS welcome, {sql_side('left')}, {sql_side('right')} FROM t),
    d AS (SELECT *, list_value({{'r': left_rank, 'w': left_wide, 'on': CASE WHEN one THEN NOT left_contra ELSE true END}}, {{'r': right_rank, 'w': right_wide, 'on': CASE WHEN one THEN NOT right_contra ELSE right_two END}}) AS da,
        list_value({{'r': left_rank, 'w': left_wide, 'on': one OR left_two}}, {{'r': right_rank, 'w': right_wide, 'on': true}}) AS db FROM s),
    e AS (SELECT *, coalesce(list_max([x.r FOR x IN da IF x.on]), 0) AS ra, coalesce(list_max([x.r FOR x IN db IF x.on]), 0) AS rb FROM d),
    f AS (SELECT *, list_max([x.w FOR x IN da IF x.on AND x.r = ra]) AS wa, list_max([x.w FOR x IN db IF x.on AND x.r = rb]) AS wb FROM e),
    o AS (SELECT *, CASE WHEN bicycle IS NOT NULL THEN welcome WHEN impassable = 'yes' THEN false WHEN vehicle = 'yes' THEN true WHEN ours AND vehicle = 'permit' AND coalesce(access <> 'no', true) THEN true
            ELSE ours AND coalesce(access = 'permissive', true) AND vehicle IS NULL END AS open,
        CASE WHEN bicycle IS NOT NULL AND NOT welcome THEN false WHEN motor_vehicle = 'no' THEN welcome OR NOT shut ELSE welcome AND coalesce(access = 'no', false) END AS carfree,
        CASE WHEN one THEN ra ELSE least(ra, rb) END AS worst, greatest(ra, rb) AS best,
        CASE WHEN one OR ra < rb THEN wa WHEN rb < ra THEN wb ELSE least(wa, wb) END AS worst_wide, CASE WHEN ra > rb THEN wa WHEN rb > ra THEN wb ELSE greatest(wa, wb) END AS best_wide FROM f),
    g AS (SELECT *, CASE WHEN trail THEN CASE WHEN NOT open OR footway = 'traffic_island' OR (footway = 'crossing' AND highway <> 'cycleway' AND coalesce(bicycle <> 'designated', true)) THEN 'none'
                WHEN footway = 'sidewalk' OR cycleway = 'sidewalk' THEN CASE WHEN bicycle = 'designated' THEN 'protected' ELSE 'none' END WHEN p_size % 4 = 0 THEN 'protected' ELSE 'path' END
            WHEN highway IS NULL OR highway = 'motorway' THEN 'none' WHEN carfree THEN 'path' ELSE ['none', CASE WHEN "cycleway:both:separation" LIKE '%bollard' THEN 'protected' ELSE 'lane' END, 'protected'][worst + 1] END AS facility,
        ['none', CASE WHEN "cycleway:both:separation" LIKE '%bollard' THEN 'protected' ELSE 'lane' END, 'protected'][best + 1] AS strong FROM o)"""


@query(f"WITH {SQL} SELECT worst AS rank, worst_wide AS width_m, best AS best_rank, best_wide AS best_width_m, count(*) AS n FROM o GROUP BY ALL")
def cycleway_provision(spark, sf_dir):
    tags = F.col("tags")
    (rank, width), (best, wide) = read.provision(tags), read.provision(tags, best=True)
    return tagged(spark, sf_dir, TAGS).groupBy(rank.alias("rank"), width.alias("width_m"), best.alias("best_rank"), wide.alias("best_width_m")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {SQL} SELECT highway, facility, CASE WHEN one AND NOT trail AND highway <> 'motorway' AND NOT carfree AND list_position(['none', 'lane', 'protected', 'path'], strong) > list_position(['none', 'lane', 'protected', 'path'], facility) THEN strong END AS shown, count(*) AS n
    FROM g GROUP BY ALL"""
)
def way_facilities(spark, sf_dir):
    tags, beside = F.col("tags"), F.col("p_size") % 4 == 0
    return tagged(spark, sf_dir, TAGS).groupBy(tags.getItem("highway").alias("highway"), read.facility(tags, beside).alias("facility"), read.shown_facility(tags, beside).alias("shown")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {SQL}, m AS (SELECT *, coalesce(footway IN ('crossing', 'traffic_island') AND highway <> 'cycleway', false) AS across, coalesce(footway = 'sidewalk' OR cycleway = 'sidewalk', false) AS walk,
            coalesce(bicycle = 'designated', false) OR (welcome AND (coalesce(name <> '', false) OR segregated IS NOT NULL)) AS kept, CASE WHEN highway = 'service' AND service = 'alley' THEN 'alley' ELSE 'road' END AS plain FROM g)
    SELECT highway, CASE WHEN highway = 'corridor' OR indoor = 'yes' OR (highway = 'service' AND service IN ('parking_aisle', 'driveway') AND NOT (welcome AND NOT shut)) THEN 'hidden'
        WHEN trail THEN CASE WHEN (walk OR across) AND NOT kept THEN 'hidden' WHEN shut AND NOT welcome AND coalesce(foot <> 'yes', true) THEN 'hidden' WHEN open OR bicycle = 'dismount' OR (bicycle IS NULL AND bicycle_road = 'yes') THEN 'road' ELSE 'barred' END
        WHEN highway IS NULL THEN 'road' WHEN welcome THEN plain WHEN shut OR bicycle = 'private' THEN 'hidden' WHEN highway = 'motorway' OR bicycle = 'no' OR motorroad = 'yes' OR (bicycle IS NULL AND impassable = 'yes') THEN 'barred' ELSE plain END AS class, count(*) AS n
    FROM m GROUP BY ALL"""
)
def map_classes(spark, sf_dir):
    return tagged(spark, sf_dir, TAGS).groupBy(F.col("tags").getItem("highway").alias("highway"), read.map_class(F.col("tags")).alias("class")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {SQL}, r AS (SELECT *, CASE WHEN p_size % 10 = 1 THEN 'military' END AS rule, p_size % 6 = 0 AS overridden, p_size % 2 = 0 AS beside FROM g)
    SELECT bicycle, CASE WHEN rule IS NOT NULL THEN rule WHEN overridden AND (welcome OR bicycle = 'dismount') THEN 'override_open' WHEN overridden AND bicycle IN ('no', 'private') THEN 'override_closed' WHEN welcome THEN NULL WHEN bicycle = 'no' THEN 'bicycle_no'
        WHEN bicycle = 'private' OR shut THEN 'private' WHEN bicycle IS NULL AND impassable = 'yes' THEN 'impassable' WHEN highway = 'motorway' THEN 'motorway' WHEN motorroad = 'yes' THEN 'motorroad'
        WHEN bicycle = 'use_sidepath' AND beside AND NOT coalesce(left_word IN ('lane', 'buffered_lane'), false) AND NOT coalesce(right_word IN ('lane', 'buffered_lane'), false) THEN 'bicycle_use_sidepath' END AS reason, count(*) AS n
    FROM r GROUP BY ALL"""
)
def access_reasons(spark, sf_dir):
    size = F.col("p_size")
    reason = read.access_reason(F.col("tags"), F.when(size % 10 == 1, "military"), size % 6 == 0, size % 2 == 0)
    return tagged(spark, sf_dir, TAGS).groupBy(F.col("tags").getItem("bicycle").alias("bicycle"), reason.alias("reason")).agg(F.count("*").alias("n"))
