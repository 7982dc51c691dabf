import pytest
from pyspark.sql import functions as F

from roadweave.functions import conditions

WEEK = [
    ("no @ (Mo-Fr 07:00-10:00,16:00-19:00)", ["weekday_rush"]),
    ("no @ (06:00-10:15,14:45-19:15)", ["weekday_rush"]),
    ("no @ (Sa-Su)", ["weekend"]),
    ("no @ (Fr 19:00 - Su 19:00)", ["weekend"]),
    ("no @ (Sa 07:00 - Su 18:00)", ["weekend"]),
    ("no @ (Su 10:00-18:00)", []),
    ("no @ (Mo-Su 20:00-07:00)", ["night"]),
    ("no @ (20:00-07:00)", ["night"]),
    ("no @ (Mo-Su 00:00-24:00)", ["weekend", "weekday_rush", "weekday_offpeak", "night"]),
    ("no @ (Su-Mo,Tu; We-Sa)", ["weekend", "weekday_rush", "weekday_offpeak", "night"]),
    ("no @ (Mo-Fr 10:00-21:00)", ["weekday_offpeak"]),
    ("no @ (Sa-Su, PH 07:00-19:00)", ["weekend"]),
    ("no @ (PH)", []),
    ("no @ (sunset-sunrise)", []),
    ("no @ (Sa-Su); no @ (sunset-sunrise)", []),
    ("no @ (Mo-Su 00:00-24:00); no @ (Apr-Oct)", []),
    ("yes @ (sunset-sunrise); no @ (Sa-Su)", ["weekend"]),
    ("no @ (Sa 09:00-09:30); no @ (Sa 15:00-15:30); no @ (Su 11:00-11:30)", ["weekend"]),
    ("no @ (Sa-Su 25:00-26:00)", []),
    ("no @ (Sa-Su 8-9)", []),
    ("destination @ (Mo-Su)", []),
    ("", []),
    (None, []),
    ("no", []),
    ("NO @ (Sa-Su)", []),
]


def test_settings(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(WEEK)], "i int, v string")
    got = {r.i: r.s for r in df.select("i", conditions.closed_settings(F.col("v")).alias("s")).collect()}
    for i, (v, want) in enumerate(WEEK):
        assert got[i] == want, v


@pytest.mark.parametrize(
    "rule, spans",
    [
        ("Mo 08:00-09:00", [(480, 540)]),
        ("Su 22:00-02:00", [(6 * 1440 + 1320, 10080), (0, 120)]),
        ("Fr 19:00 - Mo 05:00", [(4 * 1440 + 1140, 10080), (0, 300)]),
        ("Sa-Mo", [(5 * 1440, 6 * 1440), (6 * 1440, 7 * 1440), (0, 1440)]),
        ("PH off", []),
        ("", []),
        ("Jan 08:00-09:00", None),
        ("Mo 08:00", None),
        ("Fr 19:00 - Mo 25:00", None),
    ],
)
def test_rules(spark, rule, spans):
    got = spark.range(1).select(conditions.rule_intervals(F.lit(rule))).first()[0]
    assert (got if got is None else [tuple(s) for s in got]) == spans


def test_car_free(spark):
    shut = "no @ (Sa-Su)"
    rows = [
        ({"highway": "secondary", "motor_vehicle:conditional": shut}, ["weekend"]),
        ({"highway": "secondary", "motor_vehicle:conditional": "no @ (Mo-Fr 06:00-20:00)", "motorcar:conditional": shut}, ["weekend", "weekday_rush"]),
        ({"highway": "path", "motor_vehicle:conditional": shut}, []),
        ({"highway": "motorway", "motor_vehicle:conditional": shut}, []),
        ({"highway": "secondary", "bicycle": "no", "motor_vehicle:conditional": shut}, []),
        ({"highway": "secondary", "bicycle": "yes", "motor_vehicle:conditional": shut}, ["weekend"]),
        ({"motor_vehicle:conditional": shut}, []),
        ({"highway": "secondary"}, []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, tags map<string, string>")
    got = {r.i: r.s for r in df.select("i", conditions.car_free_settings(F.col("tags")).alias("s")).collect()}
    assert got == {i: s for i, (_, s) in enumerate(rows)}


def test_a_value_stands_in_the_plan_once(spark):
    from roadweave.functions import stress

    df = spark.createDataFrame([({"highway": "secondary"}, "DC", True)], "tags map<string, string>, state string, urban boolean")
    for c, most in ((conditions.car_free_settings(F.col("tags")), 60_000), (stress.base_level(F.col("tags"), F.col("state"), F.col("urban")), 160_000)):
        assert len(df.select(c.alias("s"))._jdf.queryExecution().analyzed().toString()) < most
