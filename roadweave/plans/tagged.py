"""Queries of the tag readers: ways are parts, their tags follow from the part's numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.functions import tags as read
from roadweave.plans.registry import query
from roadweave.session import table

# Way tags by the remainder of the part's key: (tag, divisor, values by remainder; None: no tag).
TAGS = (
    ("highway", 7, ("cycleway", "path", "footway", "bridleway", "residential", "steps", None)),
    ("bicycle", 11, ("yes", "no", "designated", "no;yes", "destination", "yes;permissive", None, None, None, None, None)),
    ("vehicle", 13, ("yes", "delivery", "no", "yes;private", None, None, None, None, None, None, None, None, None)),
    ("access", 17, ("yes", "no", "private", "permissive;yes", "psv", None, None, None, None, None, None, None, None, None, None, None, None)),
    ("motor_vehicle", 5, ("no", "yes", None, None, None)),
    ("psv", 19, ("designated", "yes;designated", "permit", "no", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)),
    ("footway", 9, ("sidewalk", "crossing", "traffic_island", None, None, None, None, None, None)),
    ("impassable", 23, ("yes", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)),
    ("oneway", 6, ("yes", "-1", "no", "reversible", None, None)),
    ("junction", 8, ("roundabout", None, None, None, None, None, None, None)),
    ("lanes", 10, ("1", "2", "3", "4", "5", "6", "two", None, None, None)),
    ("lanes:forward", 14, ("1", "2", "3", None, None, None, None, None, None, None, None, None, None, None)),
    ("lanes:backward", 15, ("1", "3", None, None, None, None, None, None, None, None, None, None, None, None, None)),
    ("lanes:both_ways", 12, ("1", None, None, None, None, None, None, None, None, None, None, None)),
    ("shoulder", 16, ("yes", "no", "right", "left", None, None, None, None, None, None, None, None, None, None, None, None)),
    ("shoulder:right", 18, ("yes", "no", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)),
    ("shoulder:both:width", 21, ("2.4", "8 ft", "wide", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)),
)


def sql_tags(tags=TAGS) -> str:
    """The same tags as columns."""
    cases = []
    for name, n, values in tags:
        whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
        cases.append(f"CASE (p_partkey // {len(name)}) % {n} {whens} END AS \"{name}\"")
    return f"t AS (SELECT p_partkey, p_size, {', '.join(cases)} FROM part)"


def tagged(spark, sf_dir, tags=TAGS):
    pairs = []
    for name, n, values in tags:
        at = F.floor(F.col("p_partkey") / len(name)) % n
        value = F.get(F.array(*[F.lit(v).cast("string") for v in values]), at.cast("int"))
        pairs.append(F.struct(F.lit(name).alias("k"), value.alias("v")))
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["v"].isNotNull())).alias("tags"))


def narrow(column: str) -> str:
    """SQL of an access list as its most restrictive word."""
    return f"""CASE WHEN list_contains(string_split({column}, ';'), 'no') THEN 'no' ELSE coalesce(list_filter(string_split({column}, ';'), lambda w: w NOT IN ('yes','permissive','designated','official','public','allowed'))[1], {column}) END"""


ACCESS_SQL = f"""{sql_tags()}, n AS (SELECT *, {narrow('bicycle')} AS b, {narrow('vehicle')} AS v, {narrow('access')} AS a, {narrow('psv')} AS bus FROM t),
    o AS (SELECT *, CASE WHEN b IS NOT NULL THEN b IN ('yes','designated','permissive','official','yes;permissive') WHEN impassable = 'yes' THEN false
            WHEN coalesce(v IN ('yes','yes;private'), false) AND v = 'yes' THEN true
            WHEN coalesce(highway IN ('cycleway','path'), false) AND coalesce(a NOT IN ('no','psv'), true) AND coalesce(v IN ('yes','delivery','private'), false) THEN true
            ELSE coalesce(highway IN ('cycleway','path'), false) AND coalesce(a IN ('yes','permissive;yes') AND a = 'yes', a IS NULL) AND v IS NULL END AS open,
        CASE WHEN coalesce(bus IN ('designated','yes;designated'), false) THEN false
            WHEN bicycle IS NOT NULL AND bicycle NOT IN ('yes','designated') THEN false
            WHEN motor_vehicle = 'no' THEN bicycle IS NOT NULL OR (coalesce(access = 'yes', true) AND coalesce(vehicle = 'yes', true))
            ELSE bicycle IS NOT NULL AND (coalesce(access = 'no', false) OR coalesce(vehicle = 'no', false)) END AS closed FROM n)"""


@query(f"WITH {ACCESS_SQL} SELECT b AS bicycle, v AS vehicle, a AS access, open, closed, count(*) AS n FROM o GROUP BY ALL")
def access_readers(spark, sf_dir):
    t = tagged(spark, sf_dir)
    narrowed = {k: read.most_restrictive(F.col("tags").getItem(k)).alias(k) for k in ("bicycle", "vehicle", "access")}
    return t.groupBy(*narrowed.values(), read.trail_open(F.col("tags")).alias("open"), read.closed_to_motor(F.col("tags")).alias("closed")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {ACCESS_SQL}, f AS (SELECT *, CASE WHEN highway = 'steps' OR NOT open OR footway = 'traffic_island' OR (footway = 'crossing' AND highway <> 'cycleway' AND coalesce(bicycle <> 'designated', true)) THEN 'none'
        WHEN footway = 'sidewalk' THEN CASE WHEN bicycle = 'designated' THEN 'protected' ELSE 'none' END WHEN p_size % 4 = 0 THEN 'protected' ELSE 'path' END AS facility FROM o WHERE highway IN ('cycleway','path','footway','bridleway'))
    SELECT highway, CASE WHEN NOT open THEN CASE WHEN highway <> 'footway' THEN 'closed' END WHEN facility = 'path' THEN 'open' WHEN facility = 'protected' THEN 'sidepath' WHEN highway <> 'footway' THEN 'no_facility' END AS kind, count(*) AS n FROM f GROUP BY 1, 2
    UNION ALL SELECT highway, NULL, count(*) FROM t WHERE highway IS NULL OR highway IN ('residential', 'steps') GROUP BY 1"""
)
def trail_kinds(spark, sf_dir):
    t = tagged(spark, sf_dir)
    return t.groupBy(F.col("tags").getItem("highway").alias("highway"), read.trail_kind(F.col("tags"), F.col("p_size") % 4 == 0).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {sql_tags()}, n AS (SELECT *, coalesce(oneway IN ('yes','-1'), false) OR (junction IS NOT NULL AND coalesce(oneway <> 'no', true)) AS one, TRY_CAST(lanes AS INTEGER) AS l, CAST("lanes:forward" AS INTEGER) AS f, CAST("lanes:backward" AS INTEGER) AS b, CAST("lanes:both_ways" AS INTEGER) AS m FROM t)
    SELECT one AS oneway, CASE WHEN f IS NULL AND b IS NULL THEN greatest(1, CASE WHEN one THEN l ELSE l // 2 END) + 0 * l
        WHEN f IS NOT NULL AND b IS NOT NULL OR one OR l IS NULL THEN greatest(1, f, b) ELSE greatest(1, coalesce(f, b), l - coalesce(m, 0) - coalesce(f, b)) END AS lanes, count(*) AS n FROM n GROUP BY 1, 2"""
)
def directional_lanes(spark, sf_dir):
    t = tagged(spark, sf_dir)
    return t.groupBy(read.is_oneway(F.col("tags")).alias("oneway"), read.lanes_per_direction(F.col("tags")).alias("lanes")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {sql_tags()}, n AS (SELECT *, coalesce(oneway IN ('yes','-1'), false) OR (junction IS NOT NULL AND coalesce(oneway <> 'no', true)) AS one,
            CASE "shoulder:both:width" WHEN '2.4' THEN 2.4 WHEN '8 ft' THEN 8 * 0.3048 END AS w FROM t),
    s AS (SELECT *, CASE WHEN w IS NOT NULL THEN true WHEN shoulder IN ('no','right') THEN false WHEN shoulder IN ('yes','left') THEN true END AS l,
        CASE WHEN "shoulder:right" IS NOT NULL THEN "shoulder:right" <> 'no' WHEN w IS NOT NULL THEN true WHEN shoulder IN ('no','left') THEN false WHEN shoulder IN ('yes','right') THEN true END AS r FROM n)
    SELECT CASE WHEN l IS NULL AND r IS NULL THEN NULL WHEN one THEN coalesce(l, false) OR coalesce(r, false) ELSE coalesce(l, false) AND coalesce(r, false) END AS shoulder,
        CAST(floor(1000 * CASE WHEN coalesce(r, false) THEN w END) AS BIGINT) AS right_mm, count(*) AS n FROM s GROUP BY 1, 2"""
)
def shoulders(spark, sf_dir):
    t = tagged(spark, sf_dir)
    wide = F.floor(1000 * read.shoulder_side(F.col("tags"), "right")[1])
    return t.groupBy(read.has_shoulder(F.col("tags")).alias("shoulder"), wide.alias("right_mm")).agg(F.count("*").alias("n"))


WIDTHS = ("{n}", "{n}.5m", "{n},25", "{n}'6\"", "{n}'", "{n} feet", "{n}ft", "{n}.5 M", "wide", "{n};2", "1,5,2", "")


@query(
    """WITH v AS (SELECT p_size AS n, p_partkey % 12 AS k FROM part)
    SELECT k, n, CAST(floor(1000 * CASE k WHEN 0 THEN n WHEN 1 THEN n + 0.5 WHEN 2 THEN n + 0.25 WHEN 3 THEN (n + 0.5) * 0.3048 WHEN 4 THEN n * 0.3048 WHEN 5 THEN n * 0.3048 WHEN 6 THEN n * 0.3048 WHEN 7 THEN n + 0.5 END + 0.01) AS BIGINT) AS mm, count(*) AS ways FROM v GROUP BY ALL"""
)
def widths(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("n"), (F.col("p_partkey") % 12).alias("k"))
    text = F.replace(F.get(F.array(*map(F.lit, WIDTHS)), F.col("k").cast("int")), F.lit("{n}"), F.col("n").cast("string"))
    return p.groupBy("k", "n", F.floor(1000 * read.width_m(text) + 0.01).alias("mm")).agg(F.count("*").alias("ways"))


@query(
    """WITH v AS (SELECT CAST(floor(o_totalprice) AS BIGINT) AS n, o_orderkey % 5 AS k FROM orders), t AS (SELECT n, k, format('{:,}', n) AS low, format('{:,}', n * 2) AS high FROM v)
    SELECT k, CASE k WHEN 0 THEN 0 WHEN 1 THEN n WHEN 2 THEN n END AS low, CASE k WHEN 0 THEN n - 1 WHEN 1 THEN n * 2 END AS high, count(*) AS roads FROM t GROUP BY 1, 2, 3"""
)
def count_bands(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.floor("o_totalprice").alias("n"), (F.col("o_orderkey") % 5).alias("k"))
    few, twice = F.format_number("n", 0), F.format_number(F.col("n") * 2, 0)
    text = F.when(F.col("k") == 0, F.concat(F.lit("<"), few)).when(F.col("k") == 1, F.concat(few, F.lit("-"), twice)).when(F.col("k") == 2, F.concat(few, F.lit("+"))).when(F.col("k") == 3, "no count").otherwise(F.concat(F.lit("about "), few))
    band = read.count_band(text)
    return o.groupBy("k", band["low"].alias("low"), band["high"].alias("high")).agg(F.count("*").alias("roads"))


@query(
    """WITH v AS (SELECT s_suppkey % 40 AS i, s_suppkey % 7 AS a, (s_suppkey // 7) % 7 AS b FROM supplier), q AS (SELECT *, ['', ' NW', ' northwest', ' SE', '', ' sw', ' Southwest'] AS names, ['', 'nw', 'nw', 'se', '', 'sw', 'sw'] AS quads FROM v)
    SELECT i, a, b, quads[a + 1] = '' OR quads[b + 1] = '' OR quads[a + 1] = quads[b + 1] AS same, 'main ' || CASE i % 3 WHEN 0 THEN 'street' WHEN 1 THEN 'avenue' ELSE 'road' END || ' ' || i || lower(names[a + 1]) AS written, count(*) AS n FROM q GROUP BY ALL"""
)
def street_names(spark, sf_dir):
    k = F.col("s_suppkey")
    quads = F.array(*map(F.lit, ("", " NW", " northwest", " SE", "", " sw", " Southwest")))
    s = table(spark, sf_dir, "supplier").select((k % 40).alias("i"), (k % 7).alias("a"), (F.floor(k / 7) % 7).alias("b"))
    kind = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("i") % 3).cast("int"))
    name = lambda words, q: F.concat(F.lit("Main  "), kind(words), F.lit(" "), F.col("i").cast("string"), F.get(quads, F.col(q).cast("int")))
    short, long = name(("St.", "Ave", "rd"), "a"), name(("street", "AVENUE", "Road"), "b")
    return s.groupBy("i", "a", "b", read.names_match(short, long).alias("same"), read.words_expanded(short, read.STREET_WORDS).alias("written")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {sql_tags()} SELECT '{{' || '"highway":"' || highway || '","rm:facility":"' || CASE WHEN p_size % 2 = 0 THEN 'path' ELSE 'none' END || '","rm:size":"' || p_size || '"}}' AS tags, count(*) AS n FROM t WHERE highway IS NOT NULL GROUP BY 1"""
)
def derived_tags(spark, sf_dir):
    t = tagged(spark, sf_dir).where(F.map_contains_key("tags", F.lit("highway")))
    own = F.map_filter("tags", lambda k, _: k == "highway")
    derived = F.create_map(F.lit("facility"), F.when(F.col("p_size") % 2 == 0, "path").otherwise("none"), F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.lit(None).cast("string"))
    return t.groupBy(read.canonical_map(read.overlaid(own, read.namespaced(derived, "rm:"))).alias("tags")).agg(F.count("*").alias("n"))


SURFACES = ("asphalt", "gravel", "concrete:plates", "dirt", "sett", None, "paved", "wood")


@query(
    """SELECT p_size % 8 AS k, p_size % 8 NOT IN (1, 3, 5) AS paved, count(*) AS n FROM part GROUP BY 1, 2"""
)
def paved_surfaces(spark, sf_dir):
    k = F.col("p_size") % 8
    surface = F.get(F.array(*[F.lit(s).cast("string") for s in SURFACES]), k)
    return table(spark, sf_dir, "part").groupBy(k.alias("k"), read.is_paved(surface).alias("paved")).agg(F.count("*").alias("n"))
