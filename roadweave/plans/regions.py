"""Areas as polygons, ways and routes in them, rings and strokes of ways."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from roadweave.functions import climbs
from roadweave.operators import areas, chains, tiling, windows
from roadweave.plans.matched import line
from roadweave.plans.registry import query
from roadweave.session import table

SIZE = 100.0

# An octagon around each supplier, some with a square hole; ways of three points near them.
AREAS = """c AS (SELECT s_suppkey AS area, (s_suppkey % 25 * 400)::DOUBLE AS x, (s_suppkey // 25 * 400)::DOUBLE AS y, (150 + s_suppkey % 7 * 20)::DOUBLE AS r FROM supplier),
    corner AS (SELECT * FROM (VALUES (0, 1.0, 0.0), (1, 0.75, 0.75), (2, 0.0, 1.0), (3, -0.75, 0.75), (4, -1.0, 0.0), (5, -0.75, -0.75), (6, 0.0, -1.0), (7, 0.75, -0.75)) v(i, u, w)),
    hole AS (SELECT * FROM (VALUES (0, -20, -20), (1, 20, -20), (2, 20, 20), (3, -20, 20)) v(i, u, w)),
    edges AS (
        SELECT area, x + r * a.u AS ax, y + r * a.w AS ay, x + r * b.u AS bx, y + r * b.w AS b_y FROM c, corner a JOIN corner b ON b.i = (a.i + 1) % 8
        UNION ALL SELECT area, x + a.u, y + a.w, x + b.u, y + b.w FROM c, hole a JOIN hole b ON b.i = (a.i + 1) % 4 WHERE area % 3 = 0),
    ways AS (SELECT c_custkey AS way, (c_custkey * 37 % 10000)::DOUBLE AS x, (c_custkey // 375 * 400 + c_custkey * 53 % 400)::DOUBLE AS y, (c_custkey % 11 * 30 - 151)::DOUBLE AS u, (c_custkey % 13 * 25 - 149)::DOUBLE AS w FROM customer)"""


def polygons(spark, sf_dir):
    s = F.col("s_suppkey")
    x, y, r = s % 25 * 400, F.floor(s / 25) * 400, 150 + s % 7 * 20
    star = line(*[(x + r * u, y + r * w) for u, w in ((1.0, 0.0), (0.75, 0.75), (0.0, 1.0), (-0.75, 0.75), (-1.0, 0.0), (-0.75, -0.75), (0.0, -1.0), (0.75, -0.75))])
    hole = line(*[(x + u, y + w) for u, w in ((-20, -20), (20, -20), (20, 20), (-20, 20))])
    of = table(spark, sf_dir, "supplier")
    return of.select(s.alias("area"), star.alias("pts")).unionByName(of.where(s % 3 == 0).select(s.alias("area"), hole.alias("pts")))


def ways(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, u, w = k * 37 % 10000, F.floor(k / 375) * 400 + k * 53 % 400, k % 11 * 30 - 151, k % 13 * 25 - 149
    return table(spark, sf_dir, "customer").select(k.alias("way"), line((x, y), (x + u, y + w), (x + u + 40, y + w + 10)).alias("pts"))


@query(
    f"""WITH {AREAS}, p AS (SELECT way, x + u AS x, y + w AS y FROM ways),
    near AS (SELECT *, (ay > y) <> (b_y > y) AND x < ax + (y - ay) * (bx - ax) / nullif(b_y - ay, 0) AS met, (bx - ax) * (y - ay) = (b_y - ay) * (x - ax) AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AS edge
        FROM p JOIN edges ON y BETWEEN least(ay, b_y) AND greatest(ay, b_y) AND x <= greatest(ax, bx)),
    held AS (SELECT way, area FROM near GROUP BY 1, 2 HAVING count(*) FILTER (met) % 2 = 1 OR bool_or(edge))
    SELECT way, min_by(area, (area % 4, area)) AS area FROM held GROUP BY 1"""
)
def way_areas(spark, sf_dir):
    """The area of each way by its middle point, of several the one of least rank."""
    cells = areas.area_cells(areas.ring_edges(polygons(spark, sf_dir)), SIZE)
    ranks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("area"), (F.col("s_suppkey") % 4).alias("rank"))
    return areas.way_areas(ways(spark, sf_dir), cells, SIZE, ranks)


@query(
    f"""WITH {AREAS},
    seg AS (SELECT way, 1 AS i, x AS px, y AS py, x + u AS qx, y + w AS qy FROM ways UNION ALL SELECT way, 2, x + u, y + w, x + u + 40, y + w + 10 FROM ways),
    near AS (SELECT s.*, c.area FROM seg s JOIN c ON least(px, qx) <= c.x + c.r AND greatest(px, qx) >= c.x - c.r AND least(py, qy) <= c.y + c.r AND greatest(py, qy) >= c.y - c.r),
    cuts AS (
        SELECT way, i, area, px, py, qx, qy, ((ax - px) * (b_y - ay) - (ay - py) * (bx - ax)) / nullif((qx - px) * (b_y - ay) - (qy - py) * (bx - ax), 0) AS t FROM near JOIN edges USING (area)
        UNION ALL SELECT way, i, area, px, py, qx, qy, v.t FROM near, (VALUES (0.0), (1.0)) v(t)),
    parts AS (SELECT *, lead(t) OVER (PARTITION BY way, i, area ORDER BY t) AS t2 FROM cuts WHERE t BETWEEN 0 AND 1),
    mid AS (SELECT *, px + (qx - px) * (t + t2) / 2 AS mx, py + (qy - py) * (t + t2) / 2 AS my, (t2 - t) * sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS m FROM parts WHERE t2 > t),
    held AS (
        SELECT way, area, i, t, any_value(m) AS m, count(*) FILTER ((ay > my) <> (b_y > my) AND mx < ax + (my - ay) * (bx - ax) / nullif(b_y - ay, 0)) AS n FROM mid JOIN edges USING (area) GROUP BY 1, 2, 3, 4),
    whole AS (SELECT way, sum(sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py))) AS l FROM seg GROUP BY 1)
    SELECT way, area, round(sum(m) / any_value(l), 6) AS share FROM held JOIN whole USING (way) WHERE n % 2 = 1 GROUP BY 1, 2 HAVING sum(m) / any_value(l) > 1e-6"""
)
def area_shares(spark, sf_dir):
    """Shares of each way's length by area, lines clipped to the polygons."""
    cells = areas.area_cells(areas.ring_edges(polygons(spark, sf_dir)), SIZE)
    return areas.area_shares(ways(spark, sf_dir), cells, SIZE).where("share > 1e-6").withColumn("share", F.round("share", 6))


@query()
def route_crossings(spark, sf_dir):
    """Ordered stretches of customers' routes in areas."""
    k = F.col("c_custkey")
    x, y = k * 37 % 10000, F.floor(k / 375) * 400 + k * 53 % 400
    routes = table(spark, sf_dir, "customer").select(k.alias("route"), line((x, y), (x + 900, y + 30), (x + 450, y + 300), (x, y)).alias("pts"))
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("area"), F.concat(F.lit("area "), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 9 == 0).alias("enclave"))
    cells = areas.area_cells(areas.ring_edges(polygons(spark, sf_dir)), SIZE, areas.REACH)
    found = areas.route_crossings(routes, cells, SIZE, names, least=areas.LEAST_CROSSING)
    return found.withColumns({"start": F.round("start", 6), "end": F.round("end", 6)})


# A customer's orders are ways from corner to corner of one area; of every fifth customer the last way leads elsewhere.
@query(
    """WITH w AS (SELECT o_custkey AS area, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT area, max(n) AS ways, CASE WHEN area % 5 = 0 THEN 0 ELSE max(n) END AS closed FROM w GROUP BY 1"""
)
def closed_rings(spark, sf_dir):
    """How many ways an area has, and how many of them close to rings."""
    w = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("area"), F.col("o_orderkey").alias("way"), (F.row_number().over(w.orderBy("o_orderkey")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    to = F.when((F.col("i") + 1 == F.col("n")) & (F.col("area") % 5 != 0), 0).otherwise(F.col("i") + 1)
    node = lambda i: F.col("area") * 1000 + i
    turned = F.col("way") % 2 == 0
    ends = o.select("area", F.lit("outer").alias("role"), "way", F.when(turned, node(F.col("i"))).otherwise(node(to)).alias("a"), F.when(turned, node(to)).otherwise(node(F.col("i"))).alias("b"))
    rings, _ = chains.closed_rings(ends)
    return ends.groupBy("area").agg(F.count("*").alias("ways")).join(rings.groupBy("area").agg(F.count("*").alias("closed")), "area", "left").fillna(0, ["closed"])


# Suppliers' lines: the items of a supplier in order, each going on from the one before, so a stroke may be as long as the table.
@query(
    """WITH l AS (SELECT o_orderkey AS line, o_custkey % 7 AS road, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS i, o_orderkey % 10 + 1 AS length FROM orders),
    broken AS (SELECT *, sum((line % 97 = 0)::INT) OVER (PARTITION BY road ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM l)
    SELECT road, part, min(line) AS first_line, max(line) AS last_line, count(*) AS lines, CAST(sum(length) AS BIGINT) AS length FROM broken GROUP BY 1, 2"""
)
def long_chains(spark, sf_dir):
    """Chains of lines along seven roads, broken at some lines, from partners alone."""
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), (F.col("o_custkey") % 7).alias("road"), (F.col("o_orderkey") % 10 + 1).alias("length"))
    after = windows.following(lines, "road", "line", "other", 10_000).where("other IS NOT NULL AND other % 97 != 0")
    # a line is drawn along its road or against it
    side = lambda c, ahead: F.when(F.col(c) % 3 == 0, 0 if ahead else 1).otherwise(1 if ahead else 0)
    one = after.select("line", side("line", True).alias("side"), "other", side("other", False).alias("other_side"))
    both = one.unionByName(one.select(F.col("other").alias("line"), F.col("other_side").alias("side"), F.col("line").alias("other"), F.col("side").alias("other_side")))
    placed = chains.chains(lines.select("line"), both)
    ends = placed.join(lines, "line").groupBy("chain", "road").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("lines"), F.sum("length").alias("length"))
    number = F.row_number().over(Window.partitionBy("road").orderBy("first_line"))
    broken = lines.groupBy("road").agg(F.min("line").alias("m")).select("road", (F.col("m") % 97 == 0).alias("at_once"))
    return ends.join(broken, "road").select("road", (number - F.when(F.col("at_once"), 0).otherwise(1)).cast("long").alias("part"), "first_line", "last_line", "lines", "length")


@query()
def stroke_climbs(spark, sf_dir):
    """Categorised climbs both ways along strokes of streets, of which every 50th way is one-way."""
    k = F.col("c_custkey")
    i, r = k % 40, F.floor(k / 40)
    c = table(spark, sf_dir, "customer")
    ahead = [(i * 50, r * 60), (i * 50 + 25, r * 60), (i * 50 + 50, r * 60)]
    lines = c.select(k.alias("line"), F.when(k % 3 == 0, line(*ahead[::-1])).otherwise(line(*ahead)).alias("pts"), F.lit(50.0).alias("length"))
    placed = chains.along_chains(lines, chains.strokes(lines)).withColumn("length", F.lit(50.0))
    each = c.select(k.alias("line"), F.when(k % 50 == 7, 1).alias("oneway"), F.explode(F.array(*[F.lit(x) for x in (0.0, 12.5, 25.0, 37.5, 50.0)])).alias("along"))
    x = F.col("line") % 40 * 50 + F.when(F.col("line") % 3 == 0, 50 - F.col("along")).otherwise(F.col("along"))
    samples = each.withColumn("height", F.when(F.col("line") % 211 != 0, 70 * F.sin(x / 330 + F.floor(F.col("line") / 40)) + F.floor(x / 100) % 3))
    return climbs.climbs(climbs.stroke_samples(placed, samples), both=True).withColumn("gain", F.round("gain", 6))


@query()
def drawn_tiles(spark, sf_dir):
    """Features and points of each tile at two zooms: streets merged where nothing branches, areas, and their middles."""
    scale = lambda pts: F.transform(pts, lambda p: F.struct((p["x"] / 20_000).alias("x"), (p["y"] / 20_000).alias("y")))
    streets = tiling.merged_lines(ways(spark, sf_dir).select(F.col("way").alias("line"), "pts", (F.col("way") % 3).alias("tier")), ["tier"])
    shapes = polygons(spark, sf_dir).select(F.col("area").alias("id"), F.lit("polygon").alias("kind"), scale("pts").alias("pts"), F.lit(0).cast("long").alias("tier"))
    lines_ = streets.select(F.xxhash64("pts").alias("id"), F.lit("line").alias("kind"), scale("pts").alias("pts"), "tier")
    spots = shapes.select("id", F.lit("point").alias("kind"), F.slice("pts", 1, 1).alias("pts"), "tier")
    out = None
    for zoom in (3, 5):
        drawn = tiling.tile_features(shapes.unionByName(lines_).unionByName(spots), zoom)
        n = drawn.groupBy(F.lit(zoom).alias("z"), "tx", "ty", "kind").agg(F.count("*").alias("parts"), F.sum(F.size("points")).alias("points"))
        out = n if out is None else out.unionByName(n)
    return out
