from pyspark.sql import functions as F

from roadweave.functions import stress

CASES = [
    ({"highway": "cycleway"}, None, True, 1, "trail", []),
    ({"highway": "steps"}, "DC", True, 1, "trail", []),
    ({"highway": "motorway_link", "maxspeed": "40"}, None, True, 4, "motorway", []),
    ({"highway": "primary", "cycleway": "track", "maxspeed": "45", "lanes": "6"}, None, True, 1, "separated", []),
    ({"highway": "residential", "maxspeed": "25 mph", "lanes": "2"}, None, True, 1, "mixed", []),
    ({"highway": "residential", "maxspeed": "35", "lanes": "2"}, None, True, 2, "mixed", []),
    ({"highway": "residential", "lanes": "2"}, "DC", True, 1, "mixed", ["speed"]),  # 20 by law
    ({"highway": "residential"}, "VA", True, 1, "mixed", ["speed", "lanes"]),
    ({"highway": "tertiary", "lanes": "2"}, None, False, 3, "mixed", ["speed"]),  # rural, 45
    ({"highway": "tertiary", "lanes": "2", "surface": "gravel"}, None, False, 2, "mixed", ["speed"]),
    ({"highway": "primary", "maxspeed": "30", "lanes": "4"}, None, True, 3, "mixed", []),
    ({"highway": "primary", "maxspeed": "25;40", "lanes": "4"}, None, True, 4, "mixed", []),
    ({"highway": "primary", "maxspeed:forward": "30", "maxspeed:backward": "50", "lanes": "2"}, None, True, 4, "mixed", []),
    ({"highway": "primary", "maxspeed": "none", "maxspeed:forward": "50", "lanes": "2"}, None, True, 2, "mixed", ["speed"]),  # what maxspeed says can't be read
    ({"highway": "secondary", "maxspeed": "30", "lanes": "2", "oneway": "yes"}, None, True, 2, "mixed", []),  # relief
    ({"highway": "secondary", "maxspeed": "30", "lanes": "3", "oneway": "yes"}, None, True, 4, "mixed", []),
    ({"highway": "secondary", "maxspeed": "30", "lanes": "2", "cycleway": "lane", "cycleway:width": "2"}, None, True, 1, "lane", []),
    ({"highway": "secondary", "maxspeed": "30", "lanes": "2", "cycleway": "lane"}, None, True, 2, "lane", ["width"]),
    ({"highway": "secondary", "maxspeed": "40", "lanes": "2", "cycleway": "lane", "cycleway:width": "2"}, None, True, 3, "lane", []),
    ({"highway": "secondary", "maxspeed": "25", "lanes": "4", "cycleway": "lane", "cycleway:width": "2"}, None, True, 3, "lane", []),
    ({"highway": "primary", "maxspeed": "50", "lanes": "2", "shoulder": "right", "shoulder:width": "8ft"}, None, False, 3, "shoulder", []),
    ({"highway": "primary", "maxspeed": "50", "lanes": "2", "shoulder": "right", "shoulder:width": "3ft"}, None, False, 4, "mixed", []),
    ({"highway": "residential", "maxspeed": "20", "lanes": "2", "shoulder": "right", "shoulder:width": "5ft"}, None, True, 1, "shoulder", []),  # no worse than none
]


def test_levels(spark):
    df = spark.createDataFrame([(i, t, s, u) for i, (t, s, u, *_) in enumerate(CASES)], "i int, tags map<string, string>, state string, urban boolean")
    got = {r.i: r.b for r in df.select("i", stress.base_level(F.col("tags"), F.col("state"), F.col("urban")).alias("b")).collect()}
    for i, (tags, _, _, *want) in enumerate(CASES):
        assert [got[i].level, got[i].rule, got[i].assumed] == want, (tags, got[i])


def test_tables_rise_with_speed_and_lanes():
    for table in (stress.MIXED, stress.WIDE_LANE, stress.NARROW_LANE):
        assert all(list(r) == sorted(r) and len(r) == len(stress.SPEEDS) + 1 for r in table.values())
        assert all(a <= b for k in (1, 2) for a, b in zip(table[k], table[k + 1]))
    assert all(w <= n for k in (1, 2, 3) for w, n in zip(stress.WIDE_LANE[k], stress.NARROW_LANE[k]))
