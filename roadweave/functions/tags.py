"""Readers of way tags: expressions over a map<string, string>, null where the tags don't say."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.functions.rules import first_match, lanes

METRES_PER_FOOT = 0.3048
# Access words and way classes.
PERMISSIVE = ("yes", "permissive", "designated", "official", "public", "allowed")
BICYCLE_ALLOWED = ("yes", "designated", "permissive", "official")
VEHICLE_GRANTS = ("yes", "private", "permissive", "delivery", "designated", "destination", "customers", "official", "public", "restricted", "allowed", "permit", "residents")
ACCESS_CLOSES = ("no", "agricultural", "forestry", "discouraged", "emergency", "psv")
TRAIL_CLASS = ("cycleway", "footway", "path", "pedestrian", "bridleway", "steps")
TRAIL_NETWORK = ("cycleway", "path", "bridleway")
OPEN_BY_DEFAULT = ("cycleway", "path")
ONEWAY, ONEWAY_JUNCTIONS = ("yes", "1", "-1", "true"), ("roundabout", "circular")
SHOULDER_ABSENT = ("no", "none")
# What keeps a bicycle apart from traffic, and the tags of a trail that name it.
PHYSICAL = ("flex_post", "bollard", "kerb", "planter", "jersey_barrier", "concrete_barrier", "fence", "guard_rail", "parking_lane", "vertical_panel", "hedge", "tree_row", "yes")
TRAIL_SEPARATION = ("separation", "separation:left", "separation:right", "separation:both")


def tag(tags: Column, key: str) -> Column:
    return tags.getItem(key)


def holds(condition: Column) -> Column:
    """A condition that counts as false where it is null."""
    return F.coalesce(condition, F.lit(False))


def parts(value: Column) -> Column:
    """The trimmed parts of a list with semicolons."""
    return F.transform(F.split(value, ";"), lambda p: F.trim(p))  # F.trim itself takes two columns


def width_m(value: Column) -> Column:
    """Metres of a width: a bare number or one with m, feet (', ft, feet) with or without inches, a decimal comma."""
    text = F.regexp_replace(F.lower(value), r"\s", "")
    text = F.regexp_replace(text, r"^(\d+),(\d+)$", "$1.$2")
    number = r"(\d+\.?\d*)"
    read = lambda pattern, i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).cast("double")
    feet, inches = read(rf"^{number}'{number}\"?$", 1), read(rf"^{number}'{number}\"?$", 2)
    return F.coalesce((feet + inches / 12) * METRES_PER_FOOT, read(rf"^{number}(?:'|ft|feet)$", 1) * METRES_PER_FOOT, read(rf"^{number}m?$", 1))


def most_restrictive(value: Column) -> Column:
    """A list of access words as one: no if it is among them, else the first that isn't a plain grant, else the list."""
    listed = parts(value)
    narrow = F.get(F.filter(listed, lambda p: (p != "") & ~p.isin(*PERMISSIVE)), F.lit(0))
    return F.when(F.array_contains(listed, "no"), "no").otherwise(F.coalesce(narrow, value))


def all_parts(value: Column, words) -> Column:
    return holds(F.forall(parts(value), lambda p: p.isin(*words)))


def any_part(value: Column, words) -> Column:
    return holds(F.exists(parts(value), lambda p: p.isin(*words)))


def unrestricted(tags: Column, *keys: str) -> Column:
    """No key is present with other than a plain grant."""
    out = F.lit(True)
    for k in keys:
        out = out & F.coalesce(tag(tags, k).isin(*PERMISSIVE), F.lit(True))
    return out


def physically_closed(tags: Column) -> Column:
    return holds(tag(tags, "impassable") == "yes") | holds(tag(tags, "smoothness") == "impassable")


def is_oneway(tags: Column) -> Column:
    said = tag(tags, "oneway")
    return holds(said.isin(*ONEWAY)) | (holds(tag(tags, "junction").isin(*ONEWAY_JUNCTIONS)) & F.coalesce(said != "no", F.lit(True)))


def open_to_buses(tags: Column) -> Column:
    return all_parts(most_restrictive(tag(tags, "bus")), ("yes", "designated")) | all_parts(most_restrictive(tag(tags, "psv")), ("yes", "designated"))


def trail_open(tags: Column) -> Column:
    """Whether a bicycle may ride a trail: its own tag first, then impassability, a vehicle grant, the class's default."""
    bicycle, vehicle, access = (most_restrictive(tag(tags, k)) for k in ("bicycle", "vehicle", "access"))
    ours = holds(tag(tags, "highway").isin(*OPEN_BY_DEFAULT))
    plain = lambda v: F.coalesce(v.isin(*PERMISSIVE), F.lit(True))
    granted = all_parts(vehicle, PERMISSIVE) | (ours & ~holds(access.isin(*ACCESS_CLOSES)) & any_part(vehicle, VEHICLE_GRANTS))
    return first_match([(bicycle.isNotNull(), any_part(bicycle, BICYCLE_ALLOWED)), (physically_closed(tags), False), (granted, True)], ours & plain(access) & plain(vehicle))


def closed_to_motor(tags: Column) -> Column:
    """A road closed to motor vehicles for good and open to bicycles. Buses are motor traffic."""
    bicycle = tag(tags, "bicycle")
    welcome = holds(bicycle.isin(*BICYCLE_ALLOWED))
    no = lambda k: holds(tag(tags, k) == "no")
    return first_match(
        [
            (open_to_buses(tags), False),
            (bicycle.isNotNull() & ~welcome, False),
            (no("motor_vehicle") | no("motorcar"), welcome | unrestricted(tags, "access", "vehicle")),
        ],
        welcome & (no("access") | no("vehicle")),
    )


def trail_facility(tags: Column, beside_road: Column, separation=TRAIL_SEPARATION, physical=PHYSICAL) -> Column:
    """path, protected or none of a trail-class way."""
    highway, bicycle = tag(tags, "highway"), tag(tags, "bicycle")
    said = F.array(tag(tags, "footway"), tag(tags, "path"), tag(tags, "cycleway"))
    any_of = lambda word: holds(F.array_contains(said, word))
    apart = F.lit(False)
    for key in separation:
        apart = apart | any_part(tag(tags, key), physical)
    crossing = any_of("crossing") & holds(highway != "cycleway") & F.coalesce(bicycle != "designated", F.lit(True))
    return first_match(
        [
            (holds(highway == "steps") | ~trail_open(tags) | any_of("traffic_island") | crossing, "none"),
            (any_of("sidewalk"), F.when(holds(bicycle == "designated"), "protected").otherwise("none")),
            (holds(beside_road) | holds(tag(tags, "is_sidepath") == "yes") | apart, "protected"),
        ],
        "path",
    )


def trail_kind(tags: Column, beside_road: Column) -> Column:
    """open, sidepath, closed or no_facility of a way of the trail classes, null of any other."""
    highway, kind = tag(tags, "highway"), trail_facility(tags, beside_road)
    network = F.when(highway.isin(*TRAIL_NETWORK), True)
    return first_match(
        [
            (~holds(highway.isin(*TRAIL_CLASS)) | (highway == "steps"), F.lit(None).cast("string")),
            (~trail_open(tags), F.when(network, "closed")),
            (kind == "path", "open"),
            (kind == "protected", "sidepath"),
        ],
        F.when(network, "no_facility"),
    )


def whole(value: Column) -> Column:
    """A whole number of up to nine digits."""
    return F.when(value.rlike(r"^\s*\d{1,9}\s*$"), F.trim(value)).cast("int")


def less_bays(turns: Column, count: Column) -> Column:
    """A count of lanes without those that only turn, where the turns of exactly so many are listed; one at least."""
    listed = F.split(turns, r"\|")
    through = F.size(F.filter(listed, lambda lane: (F.trim(lane) == "") | F.arrays_overlap(parts(lane), F.array(F.lit("through"), F.lit("none")))))
    return F.when(holds(F.size(listed) == count) & (turns != ""), F.greatest(through, F.lit(1))).otherwise(count)


def lanes_per_direction(tags: Column) -> Column:
    """Through lanes of the busier direction; a direction that isn't tagged is the rest of the total. Of a list of
    counts the largest holds."""
    number = lambda key: lanes(tag(tags, key))
    total, shared, oneway, ahead, back = number("lanes"), number("lanes:both_ways"), is_oneway(tags), number("lanes:forward"), number("lanes:backward")
    one = F.coalesce(ahead, back)
    rest = F.when((ahead.isNull() | back.isNull()) & total.isNotNull() & ~oneway, total - F.coalesce(shared, F.lit(0)) - one)
    through = F.greatest(less_bays(tag(tags, "turn:lanes:forward"), ahead), less_bays(tag(tags, "turn:lanes:backward"), back), rest)
    alone = F.when(oneway, total).otherwise(F.floor(total / 2).cast("int"))
    return F.when(one.isNotNull(), F.greatest(through, F.lit(1))).when(total.isNotNull(), F.greatest(alone, F.lit(1)))


def shoulder_side(tags: Column, side: str) -> tuple[Column, Column]:
    """Whether one side has a shoulder, and its width: the most specific key that speaks answers; a width is presence."""
    levels = []
    for key in (f"shoulder:{side}", "shoulder:both", "shoulder"):
        value, width = F.nullif(tag(tags, key), F.lit("")), width_m(tag(tags, f"{key}:width"))
        if key == "shoulder":
            other = holds(value.isin("left", "right") & (value != side))
            value, width = F.when(other, "no").otherwise(value), F.when(~other, width)
        levels.append((value, width))
    present, wide, below = F.lit(None).cast("boolean"), F.lit(None).cast("double"), F.lit(None).cast("double")
    for value, width in reversed(levels):
        below = F.coalesce(width, below)
        says, absent = value.isNotNull() | width.isNotNull(), width.isNull() & holds(value.isin(*SHOULDER_ABSENT))
        present, wide = F.when(says, ~absent).otherwise(present), F.when(says, F.when(~absent, below)).otherwise(wide)
    return present, wide


def has_shoulder(tags: Column) -> Column:
    """Whether riders of either direction have a shoulder; null where nothing is said of any."""
    left, right = shoulder_side(tags, "left")[0], shoulder_side(tags, "right")[0]
    both = F.when(is_oneway(tags), holds(left) | holds(right)).otherwise(holds(left) & holds(right))
    return F.when(left.isNotNull() | right.isNotNull(), both)


# Surfaces that are hard, and beginnings of more specific ones.
SEALED = ("asphalt", "concrete", "paved", "paving_stones", "chipseal")
SEALED_PREFIXES = ("concrete:", "paving_stones:", "asphalt:")
WOODEN = ("wood", "boardwalk")
ROUGH_PAVED = ("cobblestone", "unhewn_cobblestone")
HARD = ("metal", "metal_grid", "brick", "bricks", "sett", "tartan", "rubber")


def is_paved(surface: Column) -> Column:
    """Whether a surface is hard; false where none is given."""
    known = surface.isin(*SEALED, *WOODEN, *ROUGH_PAVED, *HARD)
    for p in SEALED_PREFIXES:
        known = known | surface.startswith(p)
    return holds(known)


def count_band(text: Column) -> Column:
    """struct(low, high) of '1,500-2,999', '<500' or '30,000+'; null for anything else."""
    plain = F.regexp_replace(text, ",", "")
    low, high = F.regexp_extract(plain, r"^(\d+)(?:-(\d+)|\+)$", 1), F.regexp_extract(plain, r"^(\d+)-(\d+)$", 2)
    under = F.regexp_extract(plain, r"^<(\d+)$", 1)
    number = lambda t: F.nullif(t, F.lit("")).cast("long")
    pair = lambda a, b: F.struct(a.cast("long").alias("low"), b.cast("long").alias("high"))
    return F.when(under != "", pair(F.lit(0), number(under) - 1)).when(low != "", pair(number(low), number(high)))


def words_expanded(text: Column, short: dict[str, str]) -> Column:
    """The text's words, abbreviations (with or without a full stop) written out, single-spaced, in lower case."""
    table = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    bare = lambda w: F.regexp_replace(w, r"\.$", "")
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(table[bare(w)], w)), " ")


# Words of street names written short.
STREET_WORDS = {"st": "street", "ave": "avenue", "av": "avenue", "rd": "road", "dr": "drive", "ln": "lane", "pl": "place", "ct": "court", "blvd": "boulevard", "pkwy": "parkway", "hwy": "highway", "ter": "terrace", "cir": "circle", "sq": "square"}


# Words that street keys write out.
KEY_WORDS = {
    "st": "street", "str": "street", "ave": "avenue", "av": "avenue", "rd": "road", "dr": "drive", "blvd": "boulevard", "pl": "place", "ct": "court", "ter": "terrace",
    "terr": "terrace", "pkwy": "parkway", "pky": "parkway", "hwy": "highway", "sq": "square", "cir": "circle", "ln": "lane", "br": "bridge", "brg": "bridge", "expy": "expressway",
    "fwy": "freeway", "mem": "memorial", "nw": "northwest", "ne": "northeast", "sw": "southwest", "se": "southeast", "n": "north", "s": "south", "e": "east", "w": "west",
}
KEY_QUADRANTS = ("northwest", "northeast", "southwest", "southeast")


def street_key(name: Column) -> Column:
    """The words of a street's name (letters and digits, "&" as "and"), written out: "Constitution Ave., NW" gives that of
    "Constitution Avenue Northwest". A letter before "st" or "street" stays a letter; "st" at the front is a saint."""
    table = F.create_map(*[F.lit(x) for pair in KEY_WORDS.items() for x in pair])
    words = F.regexp_extract_all(F.regexp_replace(F.lower(name), "&", " and "), F.lit("([a-z0-9]+)"), 1)

    def written(word, i):
        after = F.get(words, i + 1)
        letter = word.isin("n", "s", "e", "w") & holds(after.isin("st", "street"))
        return F.when((word == "st") & (i == 0) & after.isNotNull(), "saint").when(letter, word).otherwise(F.coalesce(table[word], word))

    return F.transform(words, written)


def names_match(a: Column, b: Column) -> Column:
    """Whether two street names are the same street: equal once written out, or equal but for a quadrant that one leaves out."""
    quads = F.array(*map(F.lit, KEY_QUADRANTS))
    plain = lambda n: F.filter(street_key(n), lambda w: ~F.array_contains(quads, w))
    quarter = lambda n: F.array_sort(F.array_intersect(street_key(n), quads))
    return (plain(a) == plain(b)) & ((F.size(quarter(a)) == 0) | (F.size(quarter(b)) == 0) | (quarter(a) == quarter(b)))


def namespaced(values: Column, prefix: str) -> Column:
    """Derived tags under a prefix of their own, without null values."""
    return F.transform_keys(F.map_filter(values, lambda _, v: v.isNotNull()), lambda k, _: F.concat(F.lit(prefix), k))


def overlaid(tags: Column, values: Column) -> Column:
    """Tags with those of values put over them."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(tags, lambda k, _: ~F.map_contains_key(values, k))), F.map_entries(values)))


def canonical_map(values: Column) -> Column:
    """JSON of a map with keys in order: equal maps have equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(values))))
