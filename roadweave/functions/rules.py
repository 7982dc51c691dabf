"""Rules as first-match expressions over a map of tags, text keys, ride times, and pure scoring."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules, default=None) -> Column:
    """The value of the first condition that holds; null conditions don't hold."""
    out = None
    for condition, value in rules:
        out = F.when(condition, F.lit(value) if not isinstance(value, Column) else value) if out is None else out.when(condition, F.lit(value) if not isinstance(value, Column) else value)
    return out.otherwise(F.lit(default) if not isinstance(default, Column) else default)


def first_tag(tags: Column, *keys: str) -> Column:
    """The first tag that is present."""
    return F.coalesce(*[tags.getItem(k) for k in keys])


# Endings that name a city's quadrant.
QUADRANTS = ("northwest", "northeast", "southwest", "southeast", "nw", "ne", "sw", "se")


def street_key(name: Column) -> Column:
    """Lower-cased, single-spaced, without its quadrant; null where nothing is left."""
    plain = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    return F.nullif(F.regexp_replace(plain, f" ({'|'.join(QUADRANTS)})$", ""), F.lit(""))


def trail_key(name: Column) -> Column:
    """A trail's name without bracketed words and endings of extensions; null where nothing is left."""
    plain = F.regexp_replace(F.lower(name), r"\s*[(\[].*$", "")
    plain = F.regexp_replace(plain, r"\s+(extension|extn|connector|connection)$", "")
    return F.nullif(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(""))


def speed_mph(value: Column) -> Column:
    """Posted speed: a number, in miles an hour unless it says kilometres."""
    number = F.regexp_extract(value, r"^\s*(\d+(?:\.\d+)?)\s*(mph|km/h|kmh|kph)?\s*$", 1)
    unit = F.regexp_extract(F.lower(value), r"(km/h|kmh|kph)\s*$", 1)
    return F.when(number != "", number.cast("double") * F.when(unit != "", 0.621371).otherwise(1.0))


def lanes(value: Column) -> Column:
    """The largest whole number of a list with semicolons."""
    return F.array_max(F.transform(F.split(value, ";"), lambda p: F.when(F.trim(p).rlike(r"^\d{1,9}$"), F.trim(p)).cast("int")))


def listed(kinds: Column, marked: Column, order: list[str], mark: str = "/list") -> Column:
    """Kinds in a fixed order, those only in `marked` with the mark; null for none."""
    parts = [F.when(F.array_contains(kinds, k), k).when(F.array_contains(marked, k), k + mark) for k in order]
    return F.nullif(F.concat_ws(",", *parts), F.lit(""))


# Hours of the day, in minutes.
NIGHT, RUSH, SUNDAY_EVENING = (21 * 60, 7 * 60), ((420, 600), (960, 1140)), 18 * 60


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday 0) of a month."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))


def federal_holiday(day: Column) -> Column:
    """Whether a date is one of the eleven holidays, as observed."""
    year = F.year(day)
    fixed = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    observed = lambda d: F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)).otherwise(d)
    last = F.last_day(fixed(year, 5, 1))
    memorial = F.date_sub(last, F.weekday(last))
    days = [observed(fixed(year, m, d)) for m, d in ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))] + [observed(fixed(year + 1, 1, 1))]
    days += [_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), memorial, _nth(year, 9, 0, 1), _nth(year, 10, 0, 2), _nth(year, 11, 3, 4)]
    return F.coalesce(*[F.when(day == d, True) for d in days], F.lit(False))


def ride_time(local: Column) -> Column:
    """night, weekend, weekday_rush or weekday_offpeak of a local date and time."""
    minute = F.hour(local) * 60 + F.minute(local)
    day = F.weekday(local)
    rush = F.lit(False)
    for a, b in RUSH:
        rush = rush | ((minute >= a) & (minute < b))
    return first_match(
        [
            ((minute >= NIGHT[0]) | (minute < NIGHT[1]), "night"),
            ((day == 6) & (minute >= SUNDAY_EVENING), "weekday_offpeak"),
            (day >= 5, "weekend"),
            (federal_holiday(F.to_date(local)), "weekday_offpeak"),
            (rush, "weekday_rush"),
        ],
        "weekday_offpeak",
    )


# Fixed values of group flow: riders per square metre, share of the width, pace, band edges.
DENSITY, UTILISATION, PACE, BANDS = 0.37, 0.7, 1.9, (60, 120, 200)


def level_riders(width: Column) -> Column:
    """Riders a minute that a width in metres carries on the level."""
    return 60.0 * DENSITY * UTILISATION * width * PACE


def band(riders: Column) -> Column:
    """0 bottleneck to 3 wide open."""
    return sum(((riders >= edge).cast("int") for edge in BANDS[1:]), (riders >= BANDS[0]).cast("int"))


# Fixed values of climb categories: name and the score it is over.
CATEGORIES = (("HC", 80_000), ("1", 64_000), ("2", 32_000), ("3", 16_000), ("4", 8_000), ("5", 4_000))


def climb_category(score: Column) -> Column:
    return first_match([(score > over, name) for name, over in CATEGORIES])


# Fixed values of riding effort: mass, rolling resistance, drag area, air density, gravity, speed.
MASS, ROLLING, DRAG, AIR, GRAVITY, SPEED = 90.0, 0.006, 0.40, 1.225, 9.80665, 20 / 3.6


def effort_factor(grade: Column, mass: float = MASS) -> Column:
    """What a metre at a grade is worth in metres on the flat, never under 1."""
    flat = mass * GRAVITY * ROLLING + 0.5 * AIR * DRAG * SPEED**2
    slope = F.atan(grade)
    force = mass * GRAVITY * (ROLLING * F.cos(slope) + F.sin(slope)) + 0.5 * AIR * DRAG * SPEED**2
    return F.greatest(force / flat, F.lit(1.0))


def piecewise(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Straight lines between knots, held past the last."""
    rules = [(x <= x1, F.lit(y0) + (y1 - y0) * (x - x0) / (x1 - x0)) for (x0, y0), (x1, y1) in zip(knots, knots[1:])]
    return first_match(rules, F.lit(knots[-1][1]))


def sun_declination(day_of_year: Column) -> Column:
    """Degrees, by the usual cosine approximation."""
    return -23.44 * F.cos(2 * math.pi / 365 * (day_of_year + 10))


def let(value: Column, f) -> Column:
    """f(value), of a value that f names more than once: it is worked out once and stands in the plan once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
