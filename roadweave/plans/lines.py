"""Operators along lines and time: running sums, islands, as-of, folds, rolling ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.functions import lines as fold
from roadweave.operators import windows
from roadweave.operators.joins import asof_join, interval_overlap_join
from roadweave.plans.registry import query
from roadweave.session import table

ORDER = ["ts", "event_id"]


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("step", F.floor(F.col("value") * 100).cast("long"))


@query(
    """SELECT event_id, user_id, CAST(lag(step) OVER w AS BIGINT) AS before, CAST(lead(step) OVER w AS BIGINT) AS after, CAST(sum(step) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS along
    FROM (SELECT *, CAST(floor(value * 100) AS BIGINT) AS step FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
)
def running_distance(spark, sf_dir):
    run = windows.running_sum(events(spark, sf_dir), ["user_id"], ORDER, "step", "along")
    w = windows.Window.partitionBy("user_id").orderBy(*ORDER)
    return run.select("event_id", "user_id", F.lag("step").over(w).alias("before"), F.lead("step").over(w).alias("after"), "along")


@query(
    """WITH marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM marked)
    SELECT user_id, session, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM numbered GROUP BY 1, 2"""
)
def islands_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = windows.previous("ts", ["user_id"], ORDER)
    found = windows.islands(e, ["user_id"], ORDER, last.isNull() | (F.col("ts") - last > F.expr("INTERVAL 12 HOUR")), "session")
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("low"), F.max("event_id").alias("high"))


@query(
    """WITH e AS (SELECT event_id, user_id, CAST(floor(value * 100) AS BIGINT) AS step, epoch_us(ts) AS spot FROM events)
    SELECT event_id, count(*) OVER w AS n, CAST(sum(step) OVER w AS BIGINT) AS near FROM e WINDOW w AS (PARTITION BY user_id ORDER BY spot RANGE BETWEEN 43200000000 PRECEDING AND 43200000000 FOLLOWING)"""
)
def rolling_range(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    half = 12 * 3600 * 10**6
    return windows.rolling_range(e, ["user_id"], "at", half, half, {"n": F.count("*"), "near": F.sum("step")}).select("event_id", "n", "near")


@query(
    """WITH a AS (SELECT * FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT a.event_id, a.user_id, b.seen FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts"""
)
def asof_stretch(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bought = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen"))
    return asof_join(bought, seen, ["user_id"], "ts", "seen_at", ["seen"]).select("event_id", "user_id", "seen")


@query(
    """WITH s AS (SELECT l_suppkey AS street, CAST(floor(l_extendedprice) AS BIGINT) AS value, CAST(sum(l_quantity) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2),
    run AS (SELECT street, value, sum(w) OVER (PARTITION BY street ORDER BY value ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY street) AS whole FROM s)
    SELECT street, min(value) AS median FROM run WHERE 2 * run >= whole GROUP BY 1"""
)
def weighted_median(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("street"), F.floor("l_extendedprice").alias("value"), F.col("l_quantity").cast("long").alias("w"))
    return windows.weighted_median(line, ["street"], "value", "w")


WAYS = """ways AS (SELECT p_partkey AS way, p_brand AS street, CAST(p_partkey * 7919 % 4001 AS BIGINT) AS x, CAST(p_partkey * 104729 % 3989 AS BIGINT) AS y, CAST(40 + p_size * 4 AS BIGINT) AS length, CAST(floor(p_retailprice) AS BIGINT) AS aadt FROM part)"""


def ways(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("way"), F.col("p_brand").alias("street"), (key * 7919 % 4001).alias("x"), (key * 104729 % 3989).alias("y"), (40 + F.col("p_size") * 4).cast("long").alias("length"), F.floor("p_retailprice").alias("aadt"))


@query(
    f"""WITH {WAYS},
    near AS (SELECT a.way, a.aadt, b.aadt AS value, b.length FROM ways a JOIN ways b ON a.street = b.street AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 160000),
    wide AS (SELECT way, aadt, count(*) AS n, CAST(sum(length) AS BIGINT) AS metres FROM near GROUP BY 1, 2 HAVING count(*) >= 3 AND sum(length) >= 250),
    sums AS (SELECT way, value, sum(length) AS w FROM near GROUP BY 1, 2),
    run AS (SELECT way, value, sum(w) OVER (PARTITION BY way ORDER BY value ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY way) AS whole FROM sums),
    median AS (SELECT way, min(value) AS median FROM run WHERE 2 * run >= whole GROUP BY 1)
    SELECT way, aadt AS raw, median AS smoothed, n, metres FROM wide JOIN median USING (way) WHERE median < aadt"""
)
def smooth_counts(spark, sf_dir):
    """A count above its street's length-weighted median nearby is lowered to it: within 400 m, three ways and 250 m at least."""
    return fold.smooth_counts(ways(spark, sf_dir))


@query(
    """WITH pages2 AS (SELECT page_id, url LIKE '%.org%' AS version, length(html) AS bytes FROM pages)
    SELECT page_id, CAST(held AS BIGINT) AS held FROM (SELECT page_id, sum(bytes) OVER (PARTITION BY version ORDER BY page_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM pages2) WHERE held > 300000"""
)
def running_bytes_evict(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").like("%.org%").alias("version"), F.char_length("html").cast("long").alias("bytes"))
    return windows.evict(p, ["version"], [F.desc("page_id")], "bytes", 300_000).select("page_id", "held")


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_k_per_group(spark, sf_dir):
    return windows.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@query(
    """WITH e AS (SELECT user_id, list({'g': 0.0::DOUBLE, 'r': value} ORDER BY ts, event_id) AS heights FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT user_id, list_reduce(heights, lambda a, x: CASE WHEN x.r > a.r + 3.0 THEN {'g': a.g + (x.r - a.r), 'r': x.r} WHEN x.r < a.r THEN {'g': a.g, 'r': x.r} ELSE a END).g AS gain FROM e"""
)
def elev_gain_fold(spark, sf_dir):
    trace = table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("p"))
    return trace.select("user_id", fold.elevation_gain(F.transform("p", lambda s: s["value"])).alias("gain"))


@query(
    """WITH line AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS size FROM events),
    piece AS (SELECT user_id, unnest(generate_series(0, greatest(size - 2, 0), 63)) AS start FROM (SELECT DISTINCT user_id, size FROM line))
    SELECT user_id, CAST(start // 63 AS BIGINT) AS ordinal, count(*) AS points, arg_min(event_id, n) AS first, arg_max(event_id, n) AS last FROM piece JOIN line USING (user_id) WHERE n BETWEEN start AND start + 63 GROUP BY 1, 2"""
)
def iter_segments(spark, sf_dir):
    line = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda s: s["event_id"]).alias("p"))
    pieces = line.select("user_id", F.posexplode(fold.pieces(F.col("p"))).alias("ordinal", "piece"))
    return pieces.select("user_id", F.col("ordinal").cast("long").alias("ordinal"), F.size("piece").cast("long").alias("points"), F.get("piece", F.lit(0)).alias("first"), F.element_at("piece", -1).alias("last"))


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_custkey AS line, CAST(o_orderkey * 37 % 5000 AS BIGINT) AS lo, CAST(o_orderkey * 37 % 5000 + 20 + o_orderkey % 400 AS BIGINT) AS hi FROM orders)
    SELECT x.id AS a, y.id AS b, x.line FROM a x JOIN a y ON x.line = y.line AND x.id < y.id AND x.lo < y.hi AND y.lo < x.hi"""
)
def interval_overlap(spark, sf_dir):
    k = F.col("o_orderkey")
    spans = table(spark, sf_dir, "orders").select(k.alias("a"), F.col("o_custkey").alias("line"), (k * 37 % 5000).alias("alo"), (k * 37 % 5000 + 20 + k % 400).alias("ahi"))
    pairs = interval_overlap_join(spans, spans.toDF("b", "line", "blo", "bhi"), ["line"], ("alo", "ahi"), ("blo", "bhi"), 250)
    return pairs.where("a < b").select("a", "b", "line")


@query(
    """WITH spans AS (SELECT o_custkey % 25 AS area, o_orderkey AS id, o_orderkey * 37 % 5000 AS lo, o_orderkey * 37 % 5000 + 20 + o_orderkey % 40 AS hi, 1 + o_orderkey % 3 AS corkers FROM orders),
    cuts AS (SELECT area, lo AS spot, corkers AS d FROM spans UNION ALL SELECT area, hi, -corkers FROM spans),
    sums AS (SELECT area, spot, sum(d) AS d FROM cuts GROUP BY 1, 2), run AS (SELECT area, spot, sum(d) OVER (PARTITION BY area ORDER BY spot ROWS UNBOUNDED PRECEDING) AS held FROM sums)
    SELECT area, CAST(max(held) AS BIGINT) AS peak, CAST(arg_min(spot, (-held, spot)) AS BIGINT) AS spot FROM run GROUP BY 1"""
)
def corker_load(spark, sf_dir):
    """The most people needed at once over half-open intervals, and where that is first so."""
    k = F.col("o_orderkey")
    spans = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("area"), (k * 37 % 5000).alias("lo"), (k * 37 % 5000 + 20 + k % 40).alias("hi"), (1 + k % 3).alias("corkers"))
    return fold.peak_load(spans, ["area"], "lo", "hi", "corkers").withColumnRenamed("at", "spot")


@query(
    """WITH e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, CAST(floor(value * 10) AS BIGINT) AS n FROM events),
    kept AS (SELECT user_id, list_sort(list(n)) AS counts FROM e WHERE back BETWEEN 2 AND 9 GROUP BY 1), now AS (SELECT user_id, n AS found FROM e WHERE back = 1),
    usual AS (SELECT user_id, found, CASE WHEN len(counts) >= 3 THEN counts[len(counts) // 2 + 1] END AS usual FROM now LEFT JOIN kept USING (user_id))
    SELECT user_id, found, usual, CASE WHEN found = 0 AND usual >= 5 THEN 'empty' WHEN found > 0 AND usual >= 20 AND found < usual * 0.2 THEN 'shrunk' END AS doubt FROM usual"""
)
def feed_doubt(spark, sf_dir):
    """The last read of each feed against the median of the eight before it."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") * 10).alias("n"))
    last = windows.top_k(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], windows.COUNTS_KEPT + 1, "back")
    reads = last.groupBy("user_id").agg(F.max(F.when(F.col("back") == 1, F.col("n"))).alias("found"), F.collect_list(F.when(F.col("back") > 1, F.col("n"))).alias("counts"))
    usual = windows.usual_count(F.col("counts"))
    return reads.withColumn("usual", usual).select("user_id", "found", "usual", windows.doubt(F.col("usual"), F.col("found")).alias("doubt"))


# A customer's orders are pieces of a route: some not rated, some after a hole; some orders are points on it.
ROLLING = """o AS (SELECT o_custkey AS route, o_orderkey AS k, 40.0 + o_orderkey % 97 AS length, CASE WHEN o_orderkey % 11 = 0 THEN 30.0 ELSE 0.0 END AS hole FROM orders),
    p AS (SELECT *, sum(length + hole) OVER (PARTITION BY route ORDER BY k ROWS UNBOUNDED PRECEDING) AS e FROM o),
    pieces AS (SELECT route, k, e - length AS s, e, CASE WHEN k % 5 > 0 THEN (k % 7) / 6.0 END AS ratio FROM p),
    points AS (SELECT route, s AS m, (k % 4 - 1) * 3.0 AS worth FROM pieces WHERE k % 6 = 0),
    samples AS (SELECT route, (s + e) / 2 AS m FROM pieces UNION ALL SELECT route, s FROM pieces),
    ends AS (SELECT route, max(e) AS fin FROM pieces GROUP BY 1),
    win AS (SELECT route, m, greatest(0.0, m - 100) AS lo, least(fin, m + 100) AS hi FROM samples JOIN ends USING (route)),
    worth AS (
        SELECT w.route, w.m, sum(greatest(0.0, least(e, hi) - greatest(s, lo))) FILTER (ratio IS NOT NULL) AS rated, sum(greatest(0.0, least(e, hi) - greatest(s, lo)) * ratio) AS calm
        FROM win w JOIN pieces USING (route) GROUP BY 1, 2),
    extra AS (SELECT w.route, w.m, sum(worth) AS worth FROM win w JOIN points p ON p.route = w.route AND p.m BETWEEN lo AND hi GROUP BY 1, 2),
    scored AS (SELECT route, m, CASE WHEN rated > 1e-9 THEN (coalesce(calm, 0) + coalesce(worth, 0)) / rated END AS score FROM worth LEFT JOIN extra USING (route, m))"""


def rolling_parts(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("route"), k.alias("k"), (40.0 + k % 97).alias("length"), F.when(k % 11 == 0, 30.0).otherwise(0.0).alias("hole"))
    w = Window.partitionBy("route").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    pieces = o.withColumn("end", F.sum(F.col("length") + F.col("hole")).over(w)).select("route", "k", (F.col("end") - F.col("length")).alias("start"), "end", F.when(F.col("k") % 5 > 0, F.col("k") % 7 / 6.0).alias("ratio"))
    points = pieces.where("k % 6 = 0").select("route", F.col("start").alias("at"), ((F.col("k") % 4 - 1) * 3.0).alias("worth"))
    samples = pieces.select("route", F.explode(F.array((F.col("start") + F.col("end")) / 2, F.col("start"))).alias("at"))
    return pieces, points, samples


@query(f'WITH {ROLLING} SELECT route, m AS "at", round(score + 1e-8, 6) AS score FROM scored')
def rolling_scores(spark, sf_dir):
    return windows.rolling_score(*rolling_parts(spark, sf_dir), "route", 200.0).withColumn("score", F.round(F.col("score") + 1e-8, 6))


@query(f"WITH {ROLLING} SELECT route, count(*) FILTER (score IS NOT NULL) AS scored, round(max(score) + 1e-8, 6) AS peak FROM scored GROUP BY 1 HAVING max(score) IS NOT NULL")
def rolling_peaks(spark, sf_dir):
    scored = windows.rolling_score(*rolling_parts(spark, sf_dir), "route", 200.0)
    n = scored.where("score IS NOT NULL").groupBy("route").agg(F.count("*").alias("scored"))
    return n.join(windows.peaks(scored, "route").select("route", F.round(F.col("score") + 1e-8, 6).alias("peak")), "route")


@query()
def route_measures(spark, sf_dir):
    """Turns, steepest run, effort windows and waits of routes of orders' items."""
    item = table(spark, sf_dir, "lineitem")
    at = F.struct("l_linenumber", "l_suppkey", "l_partkey", (-77 + F.col("l_linenumber") * 0.002 + F.col("l_partkey") % 7 * 0.0003).alias("lon"), (39 + F.col("l_suppkey") % 11 * 0.0004).alias("lat"), F.when(F.col("l_partkey") % 13 > 0, F.col("l_quantity")).alias("ele"), (F.col("l_linenumber") * 90.0).alias("m"), (F.col("l_discount") * 100).alias("seconds"))
    routes = item.groupBy(F.col("l_orderkey").alias("route")).agg(F.array_sort(F.collect_list(at)).alias("p"))
    points = F.transform("p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), p["ele"].alias("ele")))
    profile = F.transform("p", lambda p: F.struct(p["m"].alias("m"), p["ele"].alias("h")))
    marks = F.transform("p", lambda p: F.struct(p["m"].alias("m"), p["seconds"].alias("seconds")))
    return routes.select("route", fold.turns(points).alias("turns"), F.round(fold.max_grade(points), 6).alias("max_grade"), F.size(fold.effort_windows(profile)).alias("windows"), F.round(fold.waits(marks, 100.0), 6).alias("waits"))
