"""Queries of layers and reports: lines of orders are road segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadweave.operators import layers
from roadweave.plans.registry import query
from roadweave.session import dealt, table

SEGMENTS = """g AS (SELECT l_partkey AS way, CASE WHEN l_suppkey % 5 > 0 THEN 'Trail ' || l_suppkey % 50 END AS name, CAST(l_linenumber % 5 + 1 AS INTEGER) AS tier,
    CASE l_returnflag WHEN 'A' THEN 'path' WHEN 'R' THEN 'protected' ELSE 'none' END AS facility, l_orderkey % 3 = 0 AS trail, CASE WHEN l_partkey % 4 < 3 THEN l_partkey % 4 = 1 END AS unpaved,
    CAST(l_partkey % 4 AS INTEGER) AS route, CAST(l_orderkey % 3 AS INTEGER) AS bridge, CASE WHEN l_suppkey % 7 > 0 THEN CAST(l_extendedprice AS BIGINT) % 14000 END AS run_m,
    CASE WHEN l_suppkey % 6 > 0 THEN CAST(floor(l_extendedprice) AS BIGINT) % 4000 END AS calm_run_m, l_orderkey % 97 = 0 AS timed, CAST(l_quantity AS BIGINT) AS length FROM lineitem)""".replace("CAST(l_extendedprice AS BIGINT) % 14000", "CAST(floor(l_extendedprice) AS BIGINT) % 14000")


def segments(spark, sf_dir):
    supp, part, order, price = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_orderkey"), F.floor("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        part.alias("way"),
        F.when(supp % 5 > 0, F.concat(F.lit("Trail "), (supp % 50).cast("string"))).alias("name"),
        (F.col("l_linenumber") % 5 + 1).alias("tier"),
        F.when(F.col("l_returnflag") == "A", "path").when(F.col("l_returnflag") == "R", "protected").otherwise("none").alias("facility"),
        (order % 3 == 0).alias("trail"),
        F.when(part % 4 < 3, part % 4 == 1).alias("unpaved"),
        (part % 4).cast("int").alias("route"),
        (order % 3).cast("int").alias("bridge"),
        F.when(supp % 7 > 0, price % 14000).alias("run_m"),
        F.when(supp % 6 > 0, price % 4000).alias("calm_run_m"),
        F.when(order % 97 == 0, F.array(F.lit("weekend"))).otherwise(F.array().cast("array<string>")).alias("car_free"),
        F.col("l_quantity").cast("long").alias("length"),
    )


RULES = """r AS (SELECT *, facility = 'path' OR (facility = 'protected' AND trail) AS t, CASE WHEN bridge = 1 THEN false WHEN bridge = 2 THEN true ELSE coalesce(unpaved, false) END AS u, coalesce(run_m, 0) AS run, coalesce(calm_run_m, 0) AS calm FROM g),
    l AS (SELECT *, timed OR CASE WHEN u THEN route >= 3 OR run >= 8047 ELSE route >= 2 OR run >= 4023 END AS z11, timed OR CASE WHEN u THEN route >= 3 OR run >= 12875 ELSE route >= 2 OR run >= 8047 END AS z10,
        timed OR (t AND calm >= 1609.344) OR (tier <= 2 AND NOT trail AND calm >= 804.672) AS ride, timed OR t OR tier >= 3 AS busy FROM r)"""


@query(f"WITH {SEGMENTS}, {RULES} SELECT t AS trails, z11, z10, ride, busy, count(*) AS n FROM l GROUP BY 1, 2, 3, 4, 5")
def layer_predicates(spark, sf_dir):
    g = segments(spark, sf_dir)
    flags = {"trails": layers.trails(g), "z11": layers.long_trails(g, 11), "z10": layers.long_trails(g, 10), "ride": layers.ride_layer(g, layers.MILE, layers.MILE / 2), "busy": layers.busy(g)}
    return g.groupBy(*[c.alias(k) for k, c in flags.items()]).agg(F.count("*").alias("n"))


@query(f"WITH {SEGMENTS}, {RULES} SELECT 11 AS level, way, name, tier, route FROM l WHERE trail AND z11 UNION ALL SELECT 13, way, name, tier, route FROM l WHERE timed OR (trail AND calm >= 1609.344) OR (tier <= 2 AND NOT trail AND calm >= 804.672) OR trail OR tier >= 3")
def drawn_segments(spark, sf_dir):
    """A table without facility and surface columns: the rules and the columns do without them."""
    g = segments(spark, sf_dir).drop("facility")
    level = lambda z: layers.drawn(g, z, ("facility", "route")).withColumn("level", F.lit(z))
    return level(11).unionByName(level(13))


@query(f"WITH {SEGMENTS} SELECT route, count(DISTINCT way) AS ways, CAST(sum(length) AS BIGINT) AS length, CAST(coalesce(sum(length) FILTER (WHERE tier < 5), 0) AS BIGINT) AS shown, count(DISTINCT way) FILTER (WHERE name IS NOT NULL) AS named FROM g GROUP BY 1")
def level_counts(spark, sf_dir):
    return layers.by_level(segments(spark, sf_dir), "route")


@query(f"WITH {SEGMENTS} SELECT way, max(route) AS route, coalesce(max(run_m), 0) AS run_m, coalesce(max(calm_run_m), 0) AS calm_run_m FROM g WHERE way IN (SELECT p_partkey FROM part WHERE p_size = 1) GROUP BY 1")
def watched_ways(spark, sf_dir):
    ways = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("way"))
    return layers.watched(segments(spark, sf_dir), ways)


@query(
    f"""WITH {SEGMENTS} SELECT count(*) FILTER (WHERE trail AND calm_run_m >= 1609) AS path_rows, count(*) FILTER (WHERE NOT trail AND calm_run_m >= 805) AS street_rows, count(*) FILTER (WHERE calm_run_m = 0 AND name IS NOT NULL) AS unset_named,
    count(*) FILTER (WHERE route >= 2) AS on_long_route, count(*) FILTER (WHERE run_m >= 4023) AS in_long_run, CAST(sum(length) FILTER (WHERE tier >= 4) AS BIGINT) AS high_m, CAST(sum(length) FILTER (WHERE tier >= 4 AND way % 2 = 0) AS BIGINT) AS high_even_m FROM g"""
)
def run_summary(spark, sf_dir):
    g = segments(spark, sf_dir)
    length = lambda c: F.sum(F.when(c, F.col("length")))
    calm = F.col("calm_run_m")
    return g.agg(
        F.count_if(F.col("trail") & (calm >= 1609)).alias("path_rows"),
        F.count_if(~F.col("trail") & (calm >= 805)).alias("street_rows"),
        F.count_if((calm == 0) & F.col("name").isNotNull()).alias("unset_named"),
        F.count_if(F.col("route") >= 2).alias("on_long_route"),
        F.count_if(F.col("run_m") >= 4023).alias("in_long_run"),
        length(F.col("tier") >= 4).alias("high_m"),
        length((F.col("tier") >= 4) & (F.col("way") % 2 == 0)).alias("high_even_m"),
    )


@query(f"WITH {SEGMENTS} SELECT name, CAST(sum(length) AS BIGINT) AS length, CAST(floor(1e6 * sum(CASE WHEN unpaved THEN length ELSE 0 END) / nullif(sum(length), 0)) AS BIGINT) AS unpaved_ppm, count(DISTINCT way) AS ways FROM g WHERE name IS NOT NULL GROUP BY 1")
def named_trails(spark, sf_dir):
    rows = layers.trail_rows(segments(spark, sf_dir))
    return rows.select("name", "length", F.floor(1e6 * F.col("unpaved_share")).alias("unpaved_ppm"), "ways")


@query(
    """WITH m AS (UNPIVOT (SELECT l_linestatus || l_returnflag AS control, nullif(l_quantity, 25) AS left_s, l_discount * 100 AS right_s, l_tax * 100 AS through_s FROM lineitem) ON left_s, right_s, through_s INTO NAME measure VALUE value)
    SELECT control, measure, CAST(round(1000 * quantile_cont(value, 0.5)) AS BIGINT) AS median_ms FROM m WHERE value IS NOT NULL GROUP BY 1, 2 HAVING quantile_cont(value, 0.5) <> 0"""
)
def control_medians(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.concat("l_linestatus", "l_returnflag").alias("control"), F.nullif(F.col("l_quantity"), F.lit(25.0)).alias("left_s"), (F.col("l_discount") * 100).alias("right_s"), (F.col("l_tax") * 100).alias("through_s"))
    return layers.medians(rows, "control", ["left_s", "right_s", "through_s"]).select("control", "measure", F.round(1000 * F.col("median")).cast("long").alias("median_ms"))


VERTICES = """v AS (SELECT l_orderkey AS line, row_number() OVER w AS pos, count(*) OVER (PARTITION BY l_orderkey) AS last, CAST(l_partkey * 7919 % 4001 AS BIGINT) AS x, CAST(l_partkey * 104729 % 3989 AS BIGINT) AS y, l_partkey AS node FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""


def vertices(spark, sf_dir):
    line, key = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey"), F.col("l_partkey")
    w = layers.Window.partitionBy("l_orderkey")
    return line.select(F.col("l_orderkey").alias("line"), F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("at"), F.count("*").over(w).alias("last"), (key * 7919 % 4001).alias("x"), (key * 104729 % 3989).alias("y"), key.alias("node"))


@query(
    f"""WITH {VERTICES}, e AS (SELECT s_suppkey AS spot, line, bool_or(pos = 1 OR pos = last) AS ends FROM supplier JOIN v ON (s_suppkey * 7919 % 4001 - x) ** 2 + (s_suppkey * 104729 % 3989 - y) ** 2 <= 400 GROUP BY 1, 2)
    SELECT spot, bool_and(ends) AS all_end FROM e GROUP BY 1"""
)
def roads_end_here(spark, sf_dir):
    key = F.col("s_suppkey")
    spots = table(spark, sf_dir, "supplier").select(key.alias("spot"), (key * 7919 % 4001).alias("sx"), (key * 104729 % 3989).alias("sy"))
    return layers.all_end(vertices(spark, sf_dir).withColumn("first", F.lit(1)), spots, 20.0)


@query(
    f"""WITH {VERTICES} SELECT node, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS names, count(DISTINCT line) AS lines FROM v JOIN orders ON line = o_orderkey GROUP BY 1 HAVING count(DISTINCT line) > 1"""
)
def junction_names(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("name"))
    return layers.names_at(vertices(spark, sf_dir).select("node", "line").join(names, "line"))


@query("SELECT l_shipdate, l_suppkey, CAST(dense_rank() OVER (ORDER BY l_shipdate, l_suppkey) AS BIGINT) AS number FROM (SELECT DISTINCT l_shipdate, l_suppkey FROM lineitem)")
def dense_node_ids(spark, sf_dir):
    return layers.dense_numbers(table(spark, sf_dir, "lineitem"), ["l_shipdate", "l_suppkey"])


@query()
def name_chains(spark, sf_dir):
    key = F.col("p_partkey")
    lines = table(spark, sf_dir, "part").select(key.alias("id"), F.when(F.col("p_size") > 2, F.col("p_brand")).alias("name"), (key * 7919 % 4001).alias("x"), (key * 104729 % 3989).alias("y"), F.col("p_size").cast("long").alias("length"))
    return layers.chains(lines, 200.0)


@query(
    """WITH s AS (SELECT DISTINCT l_orderkey AS road, l_linenumber, l_orderkey * 10 + l_linenumber AS segment, l_linenumber * 100 AS a, l_linenumber * 100 + 100 AS b FROM lineitem),
    n AS (SELECT l_orderkey AS road, l_partkey AS line, min(l_linenumber) * 100 - 50 AS c, min(l_linenumber) * 100 - 50 + CAST(max(l_quantity) AS BIGINT) * 4 AS d FROM lineitem GROUP BY 1, 2),
    m AS (SELECT segment, line, least(b, d) - greatest(a, c) AS covered FROM s JOIN n USING (road) WHERE least(b, d) - greatest(a, c) >= 60)
    SELECT segment, line, CAST(covered AS BIGINT) AS covered FROM m QUALIFY row_number() OVER (PARTITION BY segment ORDER BY covered DESC, line) = 1"""
)
def best_covering_line(spark, sf_dir):
    line, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber").cast("long")
    s = line.select(F.col("l_orderkey").alias("road"), (F.col("l_orderkey") * 10 + n).alias("segment"), (n * 100).alias("a"), (n * 100 + 100).alias("b")).distinct()
    least = F.min(n) * 100 - 50
    lines = line.groupBy(F.col("l_orderkey").alias("road"), F.col("l_partkey").alias("line")).agg(least.alias("c"), (least + F.max("l_quantity").cast("long") * 4).alias("d"))
    return layers.best_overlap(s, lines, 0.6)


@query(
    """WITH c AS (SELECT DISTINCT l_orderkey AS trip, l_linenumber AS id, CAST(max(l_quantity) AS BIGINT) * 3 AS t_in, CAST(max(l_quantity) AS BIGINT) * 3 + 40 AS t_out, CAST(floor(max(l_extendedprice)) AS BIGINT) AS worth FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY trip ORDER BY worth DESC, id) AS rank FROM c), f AS (SELECT * FROM r WHERE rank = 1),
    o AS (SELECT r.*, r.t_in < f.t_out AND f.t_in < r.t_out AS over, f.id AS fid, f.t_in AS fin FROM r JOIN f USING (trip) WHERE r.rank > 1),
    a AS (SELECT trip, arg_min(id, rank) AS id, arg_min(t_in, rank) AS t_in FROM o WHERE NOT over GROUP BY 1), b AS (SELECT trip, arg_min(id, rank) AS id FROM o WHERE over GROUP BY 1)
    SELECT trip, 'best' AS kind, CAST(id AS VARCHAR) AS ids FROM f UNION ALL SELECT trip, 'other', CAST(id AS VARCHAR) FROM b UNION ALL SELECT a.trip, 'both', CASE WHEN a.t_in < f.t_in THEN a.id || ',' || f.id ELSE f.id || ',' || a.id END FROM a JOIN f USING (trip)"""
)
def corridor_proposals(spark, sf_dir):
    at = (F.max("l_quantity").cast("long") * 3).alias("t_in")
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("id")).agg(at, F.floor(F.max("l_extendedprice")).alias("worth"))
    return layers.proposals(c.withColumn("t_out", F.col("t_in") + 40), "trip", [F.desc("worth"), "id"])


@query(
    """WITH l AS (SELECT p_partkey AS line, p_brand AS name, p_partkey * 7919 % 4001 AS x, p_partkey * 104729 % 3989 AS y, p_partkey * 37 % 360 AS bearing FROM part)
    SELECT p.line AS a, q.line AS b FROM l p JOIN l q ON p.name = q.name AND p.line < q.line AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 10000 AND least(abs(p.bearing - q.bearing), 360 - abs(p.bearing - q.bearing)) >= 150"""
)
def carriageway_pairs(spark, sf_dir):
    key = F.col("p_partkey")
    lines = table(spark, sf_dir, "part").select(key.alias("line"), F.col("p_brand").alias("name"), (key * 7919 % 4001).alias("x"), (key * 104729 % 3989).alias("y"), (key * 37 % 360).alias("bearing"))
    return layers.opposite_carriageways(lines, 100.0, 30.0)


@query(
    """WITH s AS (SELECT user_id AS source, max(ts) FILTER (WHERE event_type <> 'error') AS read_at, 3600 * (user_id % 50 + 1) AS every_s FROM events GROUP BY 1)
    SELECT source FROM s WHERE read_at IS NULL OR floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) - floor(epoch(read_at)) >= every_s"""
)
def due_sources(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy(F.col("user_id").alias("source")).agg(F.max(F.when(F.col("event_type") != "error", F.col("ts"))).alias("read_at"), (3600 * (F.col("user_id") % 50 + 1)).alias("every_s"))
    return layers.due(s, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query(
    """WITH e AS (SELECT event_id, ts, event_id % 7 AS weekday, event_id * 13 % 1440 AS minute FROM events),
    d AS (SELECT *, date_trunc('day', ts) + to_minutes(CAST(((weekday - (isodow(ts) - 1) + 7) % 7) * 1440 + minute AS INTEGER)) AS moment FROM e)
    SELECT event_id, CAST(epoch(CASE WHEN moment < ts THEN moment + INTERVAL 7 DAY ELSE moment END) AS BIGINT) AS at_s FROM d"""
)
def soonest_instants(spark, sf_dir):
    e, k = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    return e.select("event_id", F.unix_timestamp(layers.soonest((k % 7).cast("int"), k * 13 % 1440, F.col("ts"))).alias("at_s"))


@query(
    """WITH d AS (SELECT l_orderkey AS rider, l_partkey AS dock, 'Dock ' || l_suppkey AS name, CAST(min(l_quantity) AS BIGINT) * 60 AS walk_s, CAST(min(l_linenumber) AS BIGINT) * 50 - 150 AS extra_s, CAST(min(l_quantity) AS BIGINT) * 80 AS distance, bool_or(l_returnflag <> 'R') AS usable FROM lineitem GROUP BY ALL)
    SELECT rider, dock, walk_s + greatest(extra_s, 0) AS cost, CAST(row_number() OVER w AS INTEGER) AS rank FROM d WHERE usable WINDOW w AS (PARTITION BY rider ORDER BY walk_s + greatest(extra_s, 0), distance, name, dock) QUALIFY row_number() OVER w <= 3"""
)
def start_docks(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    near = F.min("l_quantity").cast("long")
    d = line.groupBy(F.col("l_orderkey").alias("rider"), F.col("l_partkey").alias("dock"), F.concat(F.lit("Dock "), F.col("l_suppkey").cast("string")).alias("name")).agg((near * 60).alias("walk_s"), (F.min("l_linenumber").cast("long") * 50 - 150).alias("extra_s"), (near * 80).alias("distance"), F.bool_or(F.col("l_returnflag") != "R").alias("usable"))
    return layers.start_docks(d, "rider", 3)


@query(
    """WITH a AS (SELECT c_nationkey AS q, c_custkey AS id, CASE WHEN c_custkey % 9 > 0 THEN c_mktsegment END AS name, CAST(floor(c_acctbal) AS BIGINT) AS score, c_custkey * 7919 % 1000 AS x, c_custkey * 104729 % 1000 AS y FROM customer),
    b AS (SELECT * FROM a WHERE name IS NOT NULL AND x BETWEEN 100 AND 900 AND y BETWEEN 100 AND 900 QUALIFY row_number() OVER (PARTITION BY q, name, x // 250 ORDER BY score DESC, id) = 1)
    SELECT q, id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) AS rank FROM b"""
)
def place_results(spark, sf_dir):
    k = F.col("c_custkey")
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("q"), k.alias("id"), F.when(k % 9 > 0, F.col("c_mktsegment")).alias("name"), F.floor("c_acctbal").alias("score"), (k * 7919 % 1000).alias("x"), (k * 104729 % 1000).alias("y"))
    return layers.one_per_place(a.withColumn("part", F.floor(F.col("x") / 250)), "q", ["name", "part"], (100, 100, 900, 900)).select("q", "id", "rank")
