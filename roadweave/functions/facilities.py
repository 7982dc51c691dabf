"""Facility, map class and access of a way from its tags, as expressions over a map<string, string>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.functions import tags as read
from roadweave.functions.rules import first_match, let
from roadweave.functions.tags import holds, tag

# Cycleway words, and classes of ways and access that a map hides or bars.
SEPARATED, PAINTED = ("track", "opposite_track"), ("lane", "opposite_lane", "buffered_lane")
SIDE_SEPARATION = ("cycleway:left:separation", "cycleway:right:separation", "cycleway:both:separation", "cycleway:separation")
MOTOR_ONLY = ("motorway", "motorway_link")
NOT_A_WAY = ("corridor", "elevator", "platform", "bus_stop", "proposed", "construction", "raceway", "escape", "via_ferrata")
NO_PUBLIC_ACCESS = ("no", "private", "military", "restricted", "permit")
PUBLIC_WAY = ("yes", "designated", "permissive", "official", "public")
HIDDEN_SERVICE, LINK_GRANTS = ("parking_aisle", "driveway", "drive-through"), ("yes", "designated", "permissive")
BICYCLE_ROAD = ("bicycle_road", "cyclestreet")
LANES_BY_MISTAKE = ("lane", "buffered_lane")  # beside these, a side path that is asked for is a tagging error
RANKS = ("none", "lane", "protected", "path")


def side(tags: Column, name: str) -> dict[str, Column]:
    """One side of a road: value, width, rank (2 separated, 1 painted, 0), contraflow, two_way. The side's own key
    speaks before the one for both sides, and that before the bare one."""
    keys = (f"cycleway:{name}", "cycleway:both", "cycleway")
    said = lambda k: F.nullif(tag(tags, k), F.lit(""))
    value = F.coalesce(*[said(k) for k in keys])
    way = first_match([(said(k).isNotNull(), tag(tags, f"{k}:oneway")) for k in keys], F.lit(None).cast("string"))
    rank = F.when(value.isin(*SEPARATED), 2).when(value.isin(*PAINTED), 1).otherwise(0)
    reverse = holds(tag(tags, "oneway") == "-1")
    against = read.is_oneway(tags) & ((holds(way == "-1") & ~reverse) | (holds(way.isin("yes", "true", "1")) & reverse))
    width = F.when(value.isNull() | (rank > 0), F.coalesce(*[read.width_m(tag(tags, f"{k}:width")) for k in keys]))
    return {"value": value, "width": width, "rank": rank, "contraflow": against | holds(value.startswith("opposite")), "two_way": holds(way == "no")}


def provision(tags: Column, best: bool = False) -> tuple[Column, Column]:
    """(rank, width) of the direction served worst, or with `best` of the one served best."""
    told = provided(tags, best)
    return told["rank"], told["width"]


def provided(tags: Column, best: bool = False) -> Column:
    """provision's values as struct(rank, width).

    Each side serves its own direction of a two-way road, and both where it is two-way itself; every side but a
    contraflow one serves the traffic's direction of a one-way road, and all sides the other (counted with `best` only).
    Of a direction, the widest lane of its best rank; of equal directions, the narrower, with `best` the wider.
    """
    of_side = lambda name: F.struct(*[v.alias(k) for k, v in side(tags, name).items()]).alias(name)
    sides = F.struct(of_side("left"), of_side("right"), read.is_oneway(tags).alias("oneway"))

    def direction(s, serves_left, serves_right):
        left, right = s["left"], s["right"]
        of = lambda x, serves: F.when(serves, x["rank"])
        best_rank = F.coalesce(F.greatest(of(left, serves_left), of(right, serves_right)), F.lit(0))

        def widest(rank):
            wide = F.greatest(*[F.when(serves & (x["rank"] == rank), x["width"]) for x, serves in ((left, serves_left), (right, serves_right))])
            return F.struct(rank.alias("rank"), wide.alias("width"))

        return let(best_rank, widest)

    yes = F.lit(True)

    def both(s):
        left, right, oneway = s["left"], s["right"], s["oneway"]
        a = direction(s, F.when(oneway, ~left["contraflow"]).otherwise(yes), F.when(oneway, ~right["contraflow"]).otherwise(right["two_way"]))
        b = direction(s, F.when(oneway, yes).otherwise(left["two_way"]), yes)
        return let(F.struct(a.alias("a"), b.alias("b"), oneway.alias("oneway")), chosen)

    def chosen(d):
        a, b, oneway = d["a"], d["b"], d["oneway"]
        (pick, worse) = (F.greatest, b["rank"] > a["rank"]) if best else (F.least, b["rank"] < a["rank"])
        # the second direction of a one-way road is the contraflow rider's
        counts = yes if best else ~oneway
        rank = F.when(counts, pick(a["rank"], b["rank"])).otherwise(a["rank"])
        width = F.when(counts & worse, b["width"]).when(counts & (a["rank"] == b["rank"]), pick(a["width"], b["width"])).otherwise(a["width"])
        return F.struct(rank.alias("rank"), width.alias("width"))

    return let(sides, both)


def road_facility(tags: Column, rank: Column) -> Column:
    """protected, lane or none of a road whose provision has this rank; a lane behind posts or kerbs is protected."""
    apart = F.lit(False)
    for key in SIDE_SEPARATION:
        apart = apart | read.any_part(tag(tags, key), read.PHYSICAL)
    return F.when((rank >= 2) | ((rank == 1) & apart), "protected").when(rank == 1, "lane").otherwise("none")


def facility(tags: Column, beside_road: Column) -> Column:
    """path, protected, lane or none of any way; a road closed to motor traffic is a path."""
    highway = tag(tags, "highway")
    return first_match(
        [
            (highway.isin(*read.TRAIL_CLASS), read.trail_facility(tags, beside_road)),
            (highway.isNull() | highway.isin(*MOTOR_ONLY), "none"),
            (read.closed_to_motor(tags), "path"),
        ],
        road_facility(tags, provision(tags)[0]),
    )


def shown_facility(tags: Column, beside_road: Column) -> Column:
    """What a map shows of a one-way road where its best direction has more than `facility`; null elsewhere."""
    highway = tag(tags, "highway")
    shown = road_facility(tags, provision(tags, best=True)[0])
    rank = lambda f: F.array_position(F.array(*[F.lit(r) for r in RANKS]), f)
    road = read.is_oneway(tags) & ~holds(highway.isin(*read.TRAIL_CLASS, *MOTOR_ONLY)) & ~read.closed_to_motor(tags)
    return F.when(road & highway.isNotNull() & (rank(shown) > rank(facility(tags, beside_road))), shown)


def not_public(tags: Column) -> Column:
    return holds(tag(tags, "access").isin(*NO_PUBLIC_ACCESS)) | holds(tag(tags, "vehicle").isin(*NO_PUBLIC_ACCESS))


def service_link(tags: Column) -> Column:
    """A parking aisle or driveway that its own tags open to bicycles."""
    return holds(tag(tags, "highway") == "service") & holds(tag(tags, "service").isin(*HIDDEN_SERVICE)) & holds(tag(tags, "bicycle").isin(*LINK_GRANTS)) & read.unrestricted(tags, "access", "vehicle")


def sidewalk_or_crossing(tags: Column) -> Column:
    """A sidewalk or a crosswalk that isn't a trail: not designated, no named or segregated one open to bicycles."""
    bicycle = tag(tags, "bicycle")
    said = F.array(tag(tags, "footway"), tag(tags, "path"), tag(tags, "cycleway"))
    any_of = lambda word: holds(F.array_contains(said, word))
    trail = holds(bicycle == "designated") | (holds(bicycle.isin(*read.BICYCLE_ALLOWED)) & (holds(tag(tags, "name") != "") | tag(tags, "segregated").isNotNull()))
    across = (any_of("crossing") | any_of("traffic_island")) & F.coalesce(tag(tags, "highway") != "cycleway", F.lit(True))
    return ~trail & (any_of("sidewalk") | across)


def map_class(tags: Column) -> Column:
    """road, alley, barred or hidden: how a map draws a way by its own tags."""
    highway, bicycle, service = tag(tags, "highway"), tag(tags, "bicycle"), tag(tags, "service")
    closed, trail = not_public(tags), holds(highway.isin(*read.TRAIL_CLASS))
    bicycle_road = F.lit(False)
    for key in BICYCLE_ROAD:
        bicycle_road = bicycle_road | holds(tag(tags, key) == "yes")
    ridden = holds(bicycle == "dismount") | read.trail_open(tags) | (bicycle.isNull() & bicycle_road)
    opened = holds(bicycle.isin(*PUBLIC_WAY)) | holds(tag(tags, "foot").isin(*PUBLIC_WAY))
    alley = F.when(holds(highway == "service") & holds(service == "alley"), "alley").otherwise("road")
    aisle = holds(highway == "service") & holds(service.isin(*HIDDEN_SERVICE)) & ~service_link(tags)
    barred = holds(highway.isin(*MOTOR_ONLY)) | holds(bicycle == "no") | holds(tag(tags, "motorroad") == "yes") | (bicycle.isNull() & read.physically_closed(tags))
    return first_match(
        [
            (holds(highway.isin(*NOT_A_WAY)) | holds(tag(tags, "indoor") != "no") | aisle, "hidden"),
            (trail & (sidewalk_or_crossing(tags) | (closed & ~opened)), "hidden"),
            (trail, F.when(ridden, "road").otherwise("barred")),
            (highway.isNull(), "road"),
            (bicycle.isin(*read.BICYCLE_ALLOWED), alley),
            (closed | holds(bicycle == "private"), "hidden"),
            (barred, "barred"),
        ],
        alley,
    )


def access_reason(tags: Column, no_bicycle: Column, overridden: Column, side_path: Column) -> Column:
    """Why a bicycle may not use a way or why it was reopened: an override first, then a closing rule's reason
    (`no_bicycle`, null if none), then the way's own tags; null where there is nothing to say."""
    bicycle = tag(tags, "bicycle")
    ours = holds(overridden) & no_bicycle.isNull()
    painted = holds(side(tags, "left")["value"].isin(*LANES_BY_MISTAKE)) | holds(side(tags, "right")["value"].isin(*LANES_BY_MISTAKE))
    return first_match(
        [
            (ours & bicycle.isin(*read.BICYCLE_ALLOWED, "dismount"), "override_open"),
            (ours & bicycle.isin("no", "private"), "override_closed"),
            (no_bicycle.isNotNull(), no_bicycle),
            (bicycle.isin(*read.BICYCLE_ALLOWED), F.lit(None).cast("string")),
            (bicycle == "no", "bicycle_no"),
            (holds(bicycle == "private") | not_public(tags), "private"),
            (bicycle.isNull() & read.physically_closed(tags), "impassable"),
            (tag(tags, "highway").isin(*MOTOR_ONLY), "motorway"),
            (tag(tags, "motorroad") == "yes", "motorroad"),
            ((bicycle == "use_sidepath") & holds(side_path) & ~painted, "bicycle_use_sidepath"),
        ],
        F.lit(None).cast("string"),
    )
