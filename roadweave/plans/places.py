"""Operators on places: proximity, nearest, shares, cells, components, corridors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.functions import geo
from roadweave.operators import graph, joins
from roadweave.plans.registry import query
from roadweave.session import table

SITES = """a AS (SELECT c_custkey AS id, c_nationkey AS area, CAST(c_custkey * 7919 % 10007 AS BIGINT) AS x, CAST(c_custkey * 104729 % 10009 AS BIGINT) AS y FROM customer),
    b AS (SELECT s_suppkey AS sid, s_nationkey AS sarea, CAST(s_suppkey * 7919 % 10007 AS BIGINT) + 13 AS sx, CAST(s_suppkey * 15485863 % 10009 AS BIGINT) AS sy FROM supplier)"""


def sites(spark, sf_dir):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, sf_dir, "customer").select(c.alias("id"), F.col("c_nationkey").alias("area"), (c * 7919 % 10007).alias("x"), (c * 104729 % 10009).alias("y"))
    b = table(spark, sf_dir, "supplier").select(s.alias("sid"), F.col("s_nationkey").alias("sarea"), (s * 7919 % 10007 + 13).alias("sx"), (s * 15485863 % 10009).alias("sy"))
    return a, b


@query(f"WITH {SITES} SELECT id, sid, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2 FROM a JOIN b ON (x - sx) * (x - sx) + (y - sy) * (y - sy) <= 250000")
def proximity_grid_join(spark, sf_dir):
    a, b = sites(spark, sf_dir)
    return joins.proximity_join(b, a, ("sx", "sy"), ("x", "y"), 500).select("id", "sid", "d2")


@query(
    f"""WITH {SITES} SELECT id, sid, d2, rank FROM (SELECT id, sid, d2, row_number() OVER (PARTITION BY id ORDER BY d2, sid) AS rank
    FROM (SELECT id, sid, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2 FROM a CROSS JOIN b)) WHERE rank <= 2"""
)
def knn_lateral(spark, sf_dir):
    a, b = sites(spark, sf_dir)
    return joins.knn_join(a, b, "id", ("x", "y"), ("sx", "sy"), ["sid"], 2, 400).select("id", "sid", "d2", "rank")


@query(
    """WITH s AS (SELECT l_orderkey AS line, l_suppkey AS spot FROM lineitem), near AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 2000)
    SELECT line, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM near WHERE s_suppkey = spot)) AS n_hit FROM s GROUP BY 1 HAVING avg(CASE WHEN EXISTS (SELECT 1 FROM near WHERE s_suppkey = spot) THEN 1.0 ELSE 0 END) >= 0.6"""
)
def semi_fraction(spark, sf_dir):
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_suppkey").alias("spot"))
    hits = table(spark, sf_dir, "supplier").where("s_acctbal > 2000").select(F.col("s_suppkey").alias("spot"))
    return joins.semi_fraction(samples, hits, ["line"], ["spot"], 0.6)


@query(
    """WITH piece AS (SELECT l_orderkey AS piece, bool_or(l_returnflag = 'R') AS trail, CAST(sum(l_quantity) AS BIGINT) AS metres FROM lineitem GROUP BY 1 HAVING sum(l_quantity) <= 120),
    dead AS (SELECT piece, trail, metres FROM piece WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = piece AND o_orderstatus = 'F')),
    best AS (SELECT piece, p_brand, row_number() OVER (PARTITION BY piece ORDER BY p_retailprice DESC, p_partkey) AS rn FROM dead JOIN lineitem ON l_orderkey = piece JOIN part ON p_partkey = l_partkey),
    joined AS (SELECT d.piece, d.trail, d.metres, b.p_brand AS name, bool_or(d.trail) OVER (PARTITION BY b.p_brand) AS any_trail FROM dead d LEFT JOIN best b ON b.piece = d.piece AND b.rn = 1)
    SELECT name, any_trail, count(*) AS pieces, CAST(sum(metres) AS BIGINT) AS metres FROM joined GROUP BY 1, 2 HAVING bool_and(metres > 0) AND count(*) > 3"""
)
def anti_having_chain(spark, sf_dir):
    """Short clusters, without those that end elsewhere, each with its best neighbour, judged as groups."""
    line = table(spark, sf_dir, "lineitem")
    piece = line.groupBy(F.col("l_orderkey").alias("piece")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("trail"), F.sum("l_quantity").cast("long").alias("metres")).where("metres <= 120")
    ended = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("piece"))
    dead = piece.join(ended, "piece", "left_anti")
    neighbours = line.select(F.col("l_orderkey").alias("piece"), F.col("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part"), "p_partkey")
    best = joins.distinct_on(dead.select("piece").join(neighbours, "piece"), ["piece"], [F.desc("p_retailprice"), "p_partkey"]).select("piece", F.col("p_brand").alias("name"))
    named = dead.join(best, "piece", "left").withColumn("any_trail", F.bool_or("trail").over(Window.partitionBy("name")))
    return named.groupBy("name", "any_trail").agg(F.count("*").alias("pieces"), F.sum("metres").alias("metres"), F.bool_and(F.col("metres") > 0).alias("ok")).where("ok and pieces > 3").drop("ok")


@query(
    f"""WITH {SITES}, cells AS (SELECT x // 1000 AS cx, y // 1000 AS cy, CAST(sum(1 + id % 90) AS BIGINT) AS metres FROM a GROUP BY 1, 2)
    SELECT id, metres >= 800 AS dense FROM a JOIN cells ON cx = x // 1000 AND cy = y // 1000"""
)
def dense_cells(spark, sf_dir):
    a, _ = sites(spark, sf_dir)
    a = joins.with_cells(a, "x", "y", 1000)
    sums = a.groupBy("cell").agg(F.sum(1 + F.col("id") % 90).alias("metres"))
    return a.join(sums, "cell").select("id", (F.col("metres") >= 800).alias("dense"))


@query(
    """SELECT p_brand, p_size % 4 AS tier, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ' ' ORDER BY p_partkey) AS parts FROM part GROUP BY 1, 2"""
)
def merged_features(spark, sf_dir):
    """One feature for each set of properties, its geometries collected in order."""
    merged = table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 4).alias("tier")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("p"))
    return merged.select("p_brand", "tier", "n", F.array_join("p", " ").alias("parts"))


@query()
def components(spark, sf_dir):
    """Groups of customers linked through shared nodes; SQL over all of them would not finish."""
    c = table(spark, sf_dir, "customer")
    m = c.count() * 9 // 10
    return graph.components(c.select(F.col("c_custkey").alias("u"), (100000000 + F.col("c_custkey") * 31 % m).alias("v")))


@query(
    """WITH p AS (SELECT l_orderkey AS junction, a, b, abs(x - y) AS turn FROM (SELECT s.l_orderkey, s.l_partkey AS a, t.l_partkey AS b, s.l_partkey * 7 % 360 AS x, t.l_partkey * 7 % 360 AS y FROM lineitem s JOIN lineitem t ON s.l_orderkey = t.l_orderkey AND s.l_partkey < t.l_partkey)),
    d AS (SELECT DISTINCT junction, a, b, turn FROM p WHERE turn <= 60),
    ends AS (SELECT junction, a AS mine, b AS other, turn, a, b FROM d UNION ALL SELECT junction, b, a, turn, a, b FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY junction, mine ORDER BY turn, other) AS rn FROM ends)
    SELECT junction, a, b, turn FROM r WHERE rn = 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 2"""
)
def mutual_continuation(spark, sf_dir):
    """At a junction, the pairs of ways that are each other's straightest continuation."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("junction"), F.col("l_partkey").alias("a"), (F.col("l_partkey") * 7 % 360).alias("x")).distinct()
    pairs = line.join(line.toDF("junction", "b", "y"), "junction").where("a < b").select("junction", "a", "b", F.abs(F.col("x") - F.col("y")).alias("turn")).where("turn <= 60")
    ends = pairs.select("junction", F.col("a").alias("mine"), F.col("b").alias("other"), "turn", "a", "b").unionByName(pairs.select("junction", F.col("b").alias("mine"), F.col("a").alias("other"), "turn", "a", "b"))
    first = joins.distinct_on(ends, ["junction", "mine"], ["turn", "other"])
    return first.groupBy("junction", "a", "b", "turn").agg(F.count("*").alias("n")).where("n = 2").drop("n")


@query(
    """WITH p AS (SELECT DISTINCT l_orderkey AS line, l_suppkey AS vertex FROM lineitem), s AS (SELECT vertex FROM p GROUP BY 1 HAVING count(DISTINCT line) > 1),
    f AS (SELECT p.line, p.vertex, s.vertex IS NOT NULL AS shared FROM p LEFT JOIN s USING (vertex))
    SELECT line, vertex, CAST(coalesce(sum(CASE WHEN shared THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY vertex ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS piece FROM f"""
)
def split_edges(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_suppkey").alias("vertex")).distinct()
    return graph.split_at(points, "line", "vertex", "vertex", graph.shared_vertices(points, "line", "vertex")).select("line", "vertex", F.col("piece").cast("long").alias("piece"))


@query()
def corridor_loads(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, box = F.floor(F.col("o_orderkey") / 5), F.col("o_orderkey") % 5
    edges = o.select(box.alias("box"), (k % 40).alias("u"), (k * 7 % 40).alias("v"), (1 + k % 9).cast("double").alias("cost")).where("u != v").distinct()
    trips = o.groupBy(box.alias("box"), (k * 3 % 40).alias("origin"), (k * 11 % 40).alias("destination")).agg(F.count("*").alias("trips"))
    return graph.corridor_loads(edges, trips, "box")


@query()
def stop_order(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.floor((F.col("c_custkey") - 1) / 8).alias("trip"), (F.col("c_custkey") * 7919 % 1009).alias("x"), F.col("c_custkey").alias("k"))
    n = F.row_number().over(Window.partitionBy("trip").orderBy("k")) - 1
    stops = c.withColumn("i", n.cast("long"))
    # with the leg of a stop to itself, so that a trip of one customer stays
    legs = stops.select("trip", "i", "x").join(stops.select("trip", F.col("i").alias("j"), F.col("x").alias("y")), "trip")
    return graph.stop_orders(legs.select("trip", "i", "j", F.abs(F.col("x") - F.col("y")).cast("double").alias("cost")), "trip")


@query()
def greedy_diverse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("area"), "o_orderkey", (F.col("o_orderkey") * 37 % 360).alias("heading"))
    return graph.greedy_apart(o, "area", ["o_orderkey"], "heading", 40.0, 4)


@query(
    f"""WITH {SITES} SELECT area, authority, n, CAST(floor(1000.0 * n / sum(n) OVER (PARTITION BY area)) AS BIGINT) AS permille FROM (
        SELECT area, CASE WHEN x < 3000 THEN 'west' WHEN y < 5000 THEN 'south' ELSE 'north' END AS authority, count(*) AS n FROM a GROUP BY 1, 2)"""
)
def jurisdiction_share(spark, sf_dir):
    """Every authority that a way touches, with its share of the way's sample points: points in polygons."""
    a, _ = sites(spark, sf_dir)
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in (*p, p[0])])
    shapes = {"west": ring((-1, -1), (2999.5, -1), (2999.5, 20000), (-1, 20000)), "south": ring((2999.5, -1), (20000, -1), (20000, 4999.5), (2999.5, 4999.5)), "north": ring((2999.5, 4999.5), (20000, 4999.5), (20000, 20000), (2999.5, 20000))}
    found = F.coalesce(*[F.when(geo.inside(F.col("x").cast("double"), F.col("y").cast("double"), r), name) for name, r in shapes.items()])
    n = a.groupBy("area", found.alias("authority")).agg(F.count("*").alias("n"))
    return n.withColumn("permille", F.floor(1000.0 * F.col("n") / F.sum("n").over(Window.partitionBy("area"))).cast("long"))


@query(
    """SELECT z, tx, ty, count(*) AS n FROM (SELECT 12 AS z, CAST(floor((c_custkey % 3600 / 10.0 - 180.0 + 180.0) / 360.0 * 4096) AS BIGINT) AS tx,
        CAST(floor((1 - ln(tan(radians(c_custkey % 1200 / 10.0 - 60)) + 1 / cos(radians(c_custkey % 1200 / 10.0 - 60))) / pi()) / 2 * 4096) AS BIGINT) AS ty FROM customer) GROUP BY 1, 2, 3"""
)
def tile_index(spark, sf_dir):
    k = F.col("c_custkey")
    at = geo.tile(k % 3600 / 10.0 - 180.0, k % 1200 / 10.0 - 60, 12)
    return table(spark, sf_dir, "customer").select(F.lit(12).alias("z"), at.alias("t")).groupBy("z", F.col("t.x").alias("tx"), F.col("t.y").alias("ty")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {SITES}, d AS (SELECT id, sid, CAST(floor(2 * 6371008.8 * asin(sqrt(pow(sin(radians(sy - y) / 2e4), 2) + cos(radians(y / 1e4)) * cos(radians(sy / 1e4)) * pow(sin(radians(sx - x) / 2e4), 2)))) AS BIGINT) AS metres
        FROM a JOIN b ON area = sarea) SELECT id, min(metres) AS metres FROM d GROUP BY 1"""
)
def nearest_metres(spark, sf_dir):
    a, b = sites(spark, sf_dir)
    near = joins.nearest_on_sphere(a, b.withColumnRenamed("sarea", "area"), "id", ("x", "y"), ("sx", "sy"), 1e4, on=("area",))
    return near.select("id", F.floor("metres").alias("metres"))


@query(
    f"""WITH {SITES}, ids AS (SELECT id FROM a WHERE x < 2000 UNION SELECT sid FROM b WHERE sx < 2000), common AS (SELECT id FROM a INTERSECT SELECT sid FROM b)
    SELECT 'union' AS how, count(*) AS n FROM ids UNION ALL SELECT 'intersection', count(*) FROM common UNION ALL SELECT 'difference', count(*) FROM (SELECT id FROM a EXCEPT SELECT sid FROM b)"""
)
def combine_sets(spark, sf_dir):
    a, b = sites(spark, sf_dir)
    parts = {"union": a.where("x < 2000").select("id").union(b.where("sx < 2000").select("sid")).distinct(), "intersection": a.select("id").intersect(b.select("sid")), "difference": a.select("id").subtract(b.select("sid"))}
    out = None
    for how, df in parts.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(how).alias("how"), "n")
        out = n if out is None else out.unionByName(n)
    return out
