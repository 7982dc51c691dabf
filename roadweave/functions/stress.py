"""The base level of a road: what its tags say before counts, floors and restrictions (conflation.tier_steps) move it.

Levels come from the published criteria for traffic stress (Furth 2017): a table for mixed traffic by lanes and speed, one
for bike lanes by lanes, width and speed. A missing input is read as the more stressful one, and `assumed` names it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.functions import facilities
from roadweave.functions import tags as read
from roadweave.functions.rules import first_match, let, speed_mph
from roadweave.functions.tags import holds, tag

# Speeds (mph) up to which a column of the tables holds; rows by lanes of one direction; feet.
SPEEDS = (20, 25, 30, 35, 40, 45)  # and faster
MIXED = {1: (1, 1, 2, 2, 3, 3, 4), 2: (3, 3, 3, 3, 4, 4, 4), 3: (3, 3, 4, 4, 4, 4, 4)}
WIDE_LANE = {1: (1, 1, 1, 2, 3, 3, 3), 2: (2, 2, 2, 2, 3, 3, 3), 3: (3, 3, 3, 4, 4, 4, 4)}
NARROW_LANE = {1: (2, 2, 2, 2, 3, 3, 4), 2: (2, 2, 2, 2, 3, 3, 4), 3: (3, 3, 3, 4, 4, 4, 4)}
WIDE_M, LANE_40_MPH, SHOULDER_M = 6 * 0.3048, 3, 4 * 0.3048
# Speeds of unposted ways, by class, in and out of urban areas, and by law.
URBAN = {"trunk": 45, "primary": 35, "secondary": 35, "tertiary": 30, "unclassified": 25, "residential": 25, "living_street": 15, "service": 15}
RURAL = {"trunk": 55, "primary": 55, "secondary": 50, "tertiary": 45, "unclassified": 35, "residential": 30, "living_street": 15, "service": 15}
LAW, LAW_ALLEY, UNPAVED_RURAL = {"DC": 20}, {"DC": 15}, 30
DIRECTIONAL_SPEEDS = ("maxspeed:forward", "maxspeed:backward")


def fastest(value: Column) -> Column:
    """The highest speed among the parts of a list, in miles an hour; null where none can be read."""
    return F.array_max(F.transform(read.parts(value), speed_mph))


def posted_mph(tags: Column) -> Column:
    """The posted speed: that of `maxspeed`, whatever it says, else the higher of the two directions'."""
    plain = F.nullif(tag(tags, "maxspeed"), F.lit(""))
    return F.when(plain.isNotNull(), fastest(plain)).otherwise(F.greatest(*[fastest(tag(tags, k)) for k in DIRECTIONAL_SPEEDS]))


def _by_class(highway: Column, table: dict[str, int]) -> Column:
    plain = F.regexp_replace(highway, "_link$", "")
    return first_match([(plain == k, v) for k, v in table.items()], F.lit(None).cast("int"))


def read_mph(tags: Column, state: Column, urban: Column) -> tuple[Column, Column]:
    """(miles an hour, whether it was posted): the posted speed, a state's law, or what the class usually has there."""
    highway, posted = tag(tags, "highway"), posted_mph(tags)
    law = first_match([(state == s, F.when(holds(tag(tags, "service") == "alley"), LAW_ALLEY[s]).otherwise(mph)) for s, mph in LAW.items()], F.lit(None).cast("int"))
    rural = F.coalesce(_by_class(highway, RURAL), F.lit(35))
    rural = F.when(~read.is_paved(tag(tags, "surface")) & tag(tags, "surface").isNotNull(), F.least(rural, F.lit(UNPAVED_RURAL))).otherwise(rural)
    usual = F.when(holds(urban), F.coalesce(_by_class(highway, URBAN), F.lit(30))).otherwise(rural)
    return F.coalesce(posted, law.cast("double"), usual.cast("double")), posted.isNotNull()


def of_table(table: dict[int, tuple], lanes: Column, mph: Column) -> Column:
    """A table's level for lanes of one direction (3 stands for more) and a speed."""
    column = F.size(F.filter(F.array(*map(F.lit, SPEEDS)), lambda s: mph > s))
    rows = F.array(*[F.array(*map(F.lit, table[k])) for k in sorted(table)])
    return F.get(F.get(rows, F.least(F.greatest(lanes, F.lit(1)), F.lit(max(table))) - 1), column)


def lane_level(lanes: Column, mph: Column, width: Column) -> Column:
    """Level of a painted lane or shoulder; of unknown width it counts as narrow."""
    return F.when(holds(width >= WIDE_M), of_table(WIDE_LANE, lanes, mph)).otherwise(of_table(NARROW_LANE, lanes, mph))


def base_level(tags: Column, state: Column, urban: Column) -> Column:
    """struct(level, mph, lanes, rule, assumed): 1 for trails and separated tracks, 4 for motorways, else by the tables. An
    urban one-way of up to two lanes, and an urban street of several, are read as streets of one; a painted lane on a
    street of two lanes a direction (one-way: three) is 3 at least; a rideable shoulder is never worse than none."""
    mph, posted = read_mph(tags, state, urban)
    right, wide = read.shoulder_side(tags, "right")
    said = F.struct(
        tag(tags, "highway").alias("highway"), read.is_oneway(tags).alias("oneway"), mph.alias("mph"), posted.alias("posted"), read.lanes_per_direction(tags).alias("counted"),
        facilities.provided(tags).alias("lane"), holds(right).alias("right"), wide.alias("wide"),
    )
    return let(said, _of_said)


def _of_said(said: Column) -> Column:
    highway, oneway, mph, counted = (said[c] for c in ("highway", "oneway", "mph", "counted"))
    rank, width = said["lane"]["rank"], said["lane"]["width"]
    lanes = F.coalesce(counted, F.lit(1))
    relieved = F.when(oneway & (lanes <= 2), 1).otherwise(lanes)
    busy = (~oneway & (lanes >= 2)) | (oneway & (lanes >= 3))
    mixed = of_table(MIXED, relieved, mph)
    on_lane = lambda width: let(lane_level(relieved, mph, width), lambda level: F.when(busy, F.greatest(level, F.lit(3))).otherwise(level))
    painted, beside = on_lane(width), F.least(mixed, on_lane(said["wide"]))
    shoulder = said["right"] & holds(said["wide"] >= SHOULDER_M)
    level, rule = (
        first_match([(holds(highway.isin(*read.TRAIL_CLASS)), a), (holds(highway.isin(*facilities.MOTOR_ONLY)), b), (rank >= 2, c), (rank == 1, d), (shoulder, e)], f)
        for a, b, c, d, e, f in ((F.lit(1), F.lit(4), F.lit(1), painted, beside, mixed), ("trail", "motorway", "separated", "lane", "shoulder", "mixed"))
    )
    assumed = F.array_compact(F.array(F.when(~said["posted"], "speed"), F.when(counted.isNull(), "lanes"), F.when((rank == 1) & width.isNull(), "width")))
    none = rule.isin("trail", "motorway", "separated")
    return F.struct(level.alias("level"), mph.alias("mph"), lanes.alias("lanes"), rule.alias("rule"), F.when(none, F.array().cast("array<string>")).otherwise(assumed).alias("assumed"))
