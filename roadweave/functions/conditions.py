"""Conditional tags ("no @ (Mo-Fr 07:00-09:00; PH off)"): a small grammar of times, read to intervals of the week.

A value is branches, a word @ (condition); a condition is rules, parted by semicolons or by a comma before a capital; a rule
is a span of the week (Fr 19:00 - Su 06:00), or days (Mo-Fr,Su; none: every day) with times of day (none: all day; past
midnight into the next). All of it is expressions over strings and arrays, so a table of values is read in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadweave.functions.rules import let
from roadweave.functions.tags import BICYCLE_ALLOWED, TRAIL_CLASS, holds, open_to_buses, tag

# Days, settings with the instants (day, minute of the day) that each stands for, keys of motor traffic.
DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
INSTANTS = {
    "weekend": ((5, 540), (5, 900), (6, 660)),
    "weekday_rush": ((1, 480), (1, 1050)),
    "weekday_offpeak": ((1, 720), (1, 1230)),
    "night": ((1, 1320), (2, 180), (5, 1320), (6, 180)),
}
MOTOR_KEYS, MOTOR_ONLY = ("motor_vehicle", "motorcar"), ("motorway", "motorway_link")
DAY, WEEK = 1440, 10_080
SPANS = "array<struct<start: int, end: int>>"
_TIME, _DAY = r"(\d{1,2}):(\d{2})", "(" + "|".join(DAYS) + ")"
BRANCH, TIMES = r"([A-Za-z_]+)\s*@\s*\(([^)]*)\)", f"^{_TIME}-{_TIME}$"
WEEK_SPAN, DAY_RANGE = rf"^{_DAY}\s+{_TIME}\s*-\s*{_DAY}\s+{_TIME}$", f"^{_DAY}(?:-{_DAY})?$"


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _minute(text: Column, pattern: str, i: int) -> Column:
    """Minutes of the day of groups i and i + 1; over 1440 if it's no time."""
    return _group(text, pattern, i).try_cast("int") * 60 + _group(text, pattern, i + 1).try_cast("int")


def _day(text: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, DAYS)), text) - 1).cast("int")


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _wrapped(start: Column, end: Column, whole: int) -> Column:
    """One interval, or two if it runs past the end of the week."""
    return F.when(end <= start, F.array(_span(start, F.lit(whole)), _span(F.lit(0), end))).otherwise(F.array(_span(start, end)))


def _in_day(day: Column, start: Column, end: Column) -> Column:
    past, after = (day + 1) * DAY, F.pmod(day + 1, F.lit(7)) * DAY
    return F.when(end <= start, F.array(_span(day * DAY + start, past), _span(after, after + end))).otherwise(F.array(_span(day * DAY + start, day * DAY + end)))


def rule_intervals(rule: Column) -> Column:
    """A rule as intervals [start, end) of minutes of the week; empty for a public holiday's, null if it can't be read."""
    return let(F.trim(rule), lambda r: let(F.trim(F.get(F.split(r, ","), F.lit(0))).rlike(TIMES), lambda bare: _read_rule(r, bare)))


def _read_rule(rule: Column, bare: Column) -> Column:
    """bare: whether the rule is times of day alone."""

    def days_of(p):
        day = F.struct(_day(_group(p, DAY_RANGE, 1)).alias("first"), _day(F.nullif(_group(p, DAY_RANGE, 2), F.lit(""))).alias("last"))
        return let(day, lambda d: F.transform(F.sequence(F.lit(0), F.pmod(F.coalesce(d["last"], d["first"]) - d["first"], F.lit(7))), lambda i: F.pmod(d["first"] + i, F.lit(7))))

    def clock(p):
        return F.struct(p.rlike(TIMES).alias("is"), _minute(p, TIMES, 1).alias("start"), _minute(p, TIMES, 3).alias("end"))

    def daily(head, listed):
        times = F.when(bare, rule).otherwise(F.trim(F.substring(rule, F.length(head) + F.lit(2), F.lit(10_000))))
        ranges = F.transform(F.split(let(times, lambda t: F.when(t == "", "00:00-24:00").otherwise(t)), ","), lambda p: clock(F.trim(p)))
        days = F.when(bare, F.sequence(F.lit(0), F.lit(6))).otherwise(F.array_distinct(F.flatten(F.transform(listed, days_of))))

        def spread_out(ranges):
            readable = F.forall(ranges, lambda p: holds(p["is"] & (F.greatest(p["start"], p["end"]) <= DAY))) & (bare | F.forall(listed, lambda p: p.rlike(DAY_RANGE)))
            return F.when(readable, F.flatten(F.transform(days, lambda d: F.flatten(F.transform(ranges, lambda p: _in_day(d, p["start"], p["end"]))))).cast(SPANS))

        return F.when(head == "PH", F.array().cast(SPANS)).otherwise(let(ranges, spread_out))

    def weekly():
        end = lambda i: _day(_group(rule, WEEK_SPAN, i)) * DAY
        ends = F.struct(end(1).alias("a"), _minute(rule, WEEK_SPAN, 2).alias("from"), end(4).alias("z"), _minute(rule, WEEK_SPAN, 5).alias("to"))
        return let(ends, lambda e: F.when(F.greatest(e["from"], e["to"]) <= DAY, _wrapped(e["a"] + e["from"], e["z"] + e["to"], WEEK)).cast(SPANS))

    head = F.when(bare, "").otherwise(F.get(F.split(rule, " "), F.lit(0)))
    listed = lambda h: F.transform(F.split(h, ","), lambda p: F.trim(p))
    return F.when(rule == "", F.array().cast(SPANS)).when(rule.rlike(WEEK_SPAN), weekly()).otherwise(let(head, lambda h: let(listed(h), lambda parts: daily(h, parts))))


def _all_or_none(read: Column) -> Column:
    """Lists of intervals as one; null if one is null."""
    return let(read, lambda all_: F.when(F.forall(all_, lambda r: r.isNotNull()), F.flatten(all_)))


def condition_intervals(condition: Column) -> Column:
    """All intervals of a condition's rules; null if one can't be read."""
    rules = F.flatten(F.transform(F.split(condition, ";"), lambda g: F.split(g, r",\s+(?=[A-Z])")))
    return _all_or_none(F.transform(rules, rule_intervals))


def closed_intervals(value: Column) -> Column:
    """Intervals of the week in which a conditional value says "no"; null where one of its "no" branches can't be read."""
    branches = F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("(" + BRANCH + ")"), 1)
    no = F.filter(branches, lambda b: _group(b, BRANCH, 1) == "no")
    return _all_or_none(F.transform(no, lambda b: condition_intervals(_group(b, BRANCH, 2))))


def closed_settings(value: Column) -> Column:
    """The settings at whose every instant a conditional value closes a way, in order; none if it can't be read."""
    at = lambda spans, d, m: F.exists(spans, lambda s: (s["start"] <= d * DAY + m) & (d * DAY + m < s["end"]))

    def shut(spans, instants):
        all_ = F.lit(True)
        for d, m in instants:
            all_ = all_ & at(spans, d, m)
        return all_

    told = lambda spans: F.array_compact(F.array(*[F.when(shut(spans, i), name) for name, i in INSTANTS.items()]))
    return let(F.coalesce(closed_intervals(value), F.array().cast(SPANS)), told)


def car_free_settings(tags: Column) -> Column:
    """The settings in which a road is closed to motor traffic by a condition, in order; none of trails, motorways, ways that
    bar bicycles and ways with buses."""
    highway, bicycle = tag(tags, "highway"), tag(tags, "bicycle")
    never = highway.isNull() | highway.isin(*TRAIL_CLASS, *MOTOR_ONLY) | holds(bicycle.isNotNull() & ~bicycle.isin(*BICYCLE_ALLOWED)) | open_to_buses(tags)
    shut = F.array_union(*[closed_settings(tag(tags, f"{k}:conditional")) for k in MOTOR_KEYS])
    ordered = let(shut, lambda a: F.filter(F.array(*map(F.lit, INSTANTS)), lambda s: F.array_contains(a, s)))
    return F.when(never, F.array().cast("array<string>")).otherwise(ordered)
