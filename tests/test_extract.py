import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import chains
from roadweave.sources import extract


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(extract.MapExtract)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rng, path = random.Random(1), str(tmp_path_factory.mktemp("extract"))
    nodes = [(i * 3 - 50, round(-77 + rng.uniform(-1, 1), 7), round(39 + rng.uniform(-1, 1), 7), {"name": f"n{i} é", "highway": "stop"} if i % 4 == 0 else {}) for i in range(20_000)]
    ways = [(2**40 + i, {"highway": rng.choice(["path", "primary"]), "ref": str(i)} if i % 9 else {}, [rng.randrange(-17, 19_000) * 3 + 1 for _ in range(rng.randrange(9))]) for i in range(1000)]
    ways += [(10 + k, {}, [1, 4] if k == 0 else [4, 7] if k == 1 else [7, 1]) for k in range(3)]
    relations = [(1, {"boundary": "administrative", "admin_level": "4", "ref": "XX"}, [("way", 10, "outer"), ("way", 11, ""), ("way", 12, "outer"), ("node", 1, "label")]), (2, {"route": "hiking;bicycle", "network": "ncn"}, [("way", 10, "")]), (3, {"route": "mtb"}, [("way", 10, ""), ("way", 11, "")]), (4, {}, [])]
    for kind, rows in (("nodes", nodes), ("ways", ways), ("relations", relations)):
        df = spark.createDataFrame(rows, extract.SCHEMAS[kind]).repartitionByRange(3, "id").sortWithinPartitions("id")
        df.write.format("map_extract").option("kind", kind).mode("append").save(path)
    return path, nodes, ways, relations


def table(spark, path, kind, **options):
    return spark.read.format("map_extract").option("kind", kind).options(**options).load(path)


def test_round_trip(spark, folder):
    path, nodes, ways, relations = folder
    got = {r.id: (r.lon, r.lat, r.tags) for r in table(spark, path, "nodes", blobs="1").collect()}
    assert len(got) == len(nodes) and all(abs(got[i][0] - lon) < 1e-9 and abs(got[i][1] - lat) < 1e-9 and got[i][2] == tags for i, lon, lat, tags in nodes)
    assert sorted((r.id, r.tags, r.refs) for r in table(spark, path, "ways").collect()) == sorted(ways, key=lambda w: w[0])
    assert {r.id: (r.tags, [tuple(m) for m in r.members]) for r in table(spark, path, "relations").collect()} == {i: (t, m) for i, t, m in relations}
    assert table(spark, path, "nodes", blobs="1").rdd.getNumPartitions() >= 3


def test_ids_are_filtered_in_the_reader(spark, folder):
    path, nodes, _, _ = folder
    some = table(spark, path, "nodes").where("id >= 100 AND id < 130")
    assert sorted(r.id for r in some.collect()) == [i for i, *_ in nodes if 100 <= i < 130]
    assert sorted(r.id for r in table(spark, path, "nodes").where("id IN (1, 4, 5)").collect()) == [1, 4]
    reader = extract.ExtractReader({"path": path, "kind": "nodes"})
    left = list(reader.pushFilters([extract.GreaterThan(("id",), 5), extract.EqualTo(("lon",), 1.0), extract.In(("id",), (7, 8)), extract.LessThanOrEqual(("id",), 7)]))
    assert len(left) == 1 and (reader.wanted.low, reader.wanted.high, reader.wanted.among) == (6, 7, frozenset({7, 8}))


def test_scans(spark, folder):
    path, nodes, ways, _ = folder
    n, w, r = (table(spark, path, k) for k in ("nodes", "ways", "relations"))
    at = {i: (lon, lat) for i, lon, lat, _ in nodes}
    want = {i: [at[x] for x in refs if x in at] for i, tags, refs in ways if tags.get("highway") == "path"}
    got = {x.id: [(p.lon, p.lat) for p in x.pts] for x in extract.located_ways(w, n, F.col("tags")["highway"] == "path").collect()}
    assert got.keys() == {i for i, p in want.items() if len(p) > 1}
    assert all(abs(a[0] - b[0]) < 1e-9 and abs(a[1] - b[1]) < 1e-9 for i in got for a, b in zip(got[i], want[i])) and all(len(got[i]) == len(want[i]) for i in got)
    assert {(x.way, x.hiking, tuple(x.bicycle_networks), x.mtb) for x in extract.route_members(r).collect()} == {(10, True, ("ncn",), True), (11, False, (), True)}
    of = extract.boundary_ways(r)
    assert {tuple(x) for x in of.collect()} == {("XX", "outer", 10), ("XX", "outer", 11), ("XX", "outer", 12)}
    ends = of.join(w.select(F.col("id").alias("way"), F.get("refs", F.lit(0)).alias("a"), F.try_element_at("refs", F.lit(-1)).alias("b")), "way")
    assert {x.way for x in chains.closed_rings(ends)[0].collect()} == {10, 11, 12}
    box = (-77.2, 38.8, -76.8, 39.2)
    stops = extract.nodes_in_box(n, box, F.col("tags")["highway"] == "stop")
    assert {x.id for x in stops.collect()} == {i for i, lon, lat, t in nodes if t and box[0] <= lon <= box[2] and box[1] <= lat <= box[3]}


def test_missing_and_empty(spark, tmp_path):
    spark.dataSource.register(extract.MapExtract)
    with pytest.raises(Exception, match="FileNotFound|No such|nowhere"):
        table(spark, f"{tmp_path}/nowhere.pbf", "ways").collect()
    assert table(spark, str(tmp_path), "ways").collect() == []
