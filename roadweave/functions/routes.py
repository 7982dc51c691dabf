"""Measures of routes and lines: grades, climbs, revisits, bends, hill shares, detours, thinner and encoded lines.

A route is rows of (route, along metres, ...) in order; window functions over a route's own rows and equi-joins on
cells do the work. Only sequential state machines (climbs, simplifying) run one route at a time in pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.operators.joins import interval_overlap_join, with_cells

# Samples either side of a grade; dips, flats and rises of climbs; what climbs cost; flow on grades; detours.
GRADE_SPAN = 2
DIP_M, FLAT_M, MIN_RISE_M, CLIMB_KICK_M = 3.0, 150.0, 5.0, 150.0
FREE_GRADE, STEEPENING, SUSTAIN_M, COST_S_PER_M = 0.03, 0.03, 1000.0, 1.7
FREE_CLIMB_GRADE, CLIMB_SLOWING, MIN_SPEED, BRAKE_GRADE, SPACING, MIN_SPACING = 0.01, 12.0, 0.3, 0.04, 5.0, 0.6
REVISIT_M, REVISIT_ALONG_M = 25.0, 400.0
SILENT_RATIO, SILENT_EXTRA_M, NOTE_RATIO, STRONG_RATIO = 1.25, 0.33 * 1609.344, 1.5, 2.0
MIN_SPAN_M, MIN_STEP_M = 200.0, 0.5
MIN_CROSSING_M = 0.1 * 1609.344


def grades(samples: DataFrame, route: str, along: str, height: str, span: int = GRADE_SPAN) -> DataFrame:
    """Adds grade: rise over run across up to span samples either side, not past a gap in the heights; null at gaps,
    alone, and where the samples stand at one place."""
    order = Window.partitionBy(route).orderBy(along)
    gap = F.sum(F.col(height).isNull().cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    w = Window.partitionBy(route, "__gap", F.col(height).isNull()).orderBy(along)
    around = w.rowsBetween(-span, span)
    rise = F.last(height).over(around) - F.first(height).over(around)
    run = F.last(along).over(around) - F.first(along).over(around)
    return samples.withColumn("__gap", gap).withColumn("grade", F.when(F.col(height).isNotNull() & (run > 0), rise / run)).drop("__gap")


def highs(e: np.ndarray, at: np.ndarray, dip: float, flat: float) -> int:
    """The place of the high that a rise from the first sample reaches before it ends: at the first sample more than dip
    below the highest so far, or more than flat past it. Looks ahead in windows that double."""
    reach = 64
    while True:
        part = e[:reach]
        high = np.maximum.accumulate(part)
        met = np.maximum.accumulate(np.where(np.append(True, part[1:] > high[:-1]), np.arange(len(part)), 0))
        over = np.flatnonzero((high - part > dip) | (at[:reach] - at[met] > flat))
        if len(over):
            return int(met[over[0]])
        if reach >= len(e):
            return int(met[-1])
        reach *= 2


def sustained(at: np.ndarray, height: np.ndarray, sign: float) -> list[tuple[float, float, float]]:
    """(start, end, rise) of the sustained rises of sign * height: from a low to the highest point before the profile
    dips by more than DIP_M or stays below it for more than FLAT_M; the next is looked for from there on."""
    e = sign * height
    rising, out, low = np.flatnonzero(np.diff(e) > 0), [], 0
    while len(after := rising[np.searchsorted(rising, low) :]):
        low = int(after[0])  # where a step goes up again
        top = low + highs(e[low:], at[low:], DIP_M, FLAT_M)
        if e[top] - e[low] >= MIN_RISE_M:
            out.append((at[low], at[top], sign * (e[top] - e[low])))
        low = top
    return out


def climb_runs(samples: DataFrame, route: str = "route", along: str = "along", height: str = "height") -> DataFrame:
    """(route, start, end, rise) of the sustained climbs and descents (rise below 0). A null height breaks the profile.

    One route's samples go to one task; routes are many and short next to a partition."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found = []
        batch = batch.sort_values(along)
        key, at, heights = batch[route].iloc[0], batch[along].to_numpy(float), batch[height].to_numpy(float)
        known = ~np.isnan(heights)
        for piece in np.split(np.arange(len(at)), np.flatnonzero(known[1:] != known[:-1]) + 1):
            if known[piece[0]] and len(piece) > 1:
                for sign in (1.0, -1.0):
                    found += [(key, *r) for r in sustained(at[piece], heights[piece], sign)]
        return pd.DataFrame(found, columns=["route", "start", "end", "rise"])

    kind = dict(samples.dtypes)[route]
    rows = samples.select(route, F.col(along).cast("double").alias(along), F.col(height).cast("double").alias(height))
    return rows.groupBy(route).applyInPandas(run, f"route {kind}, start double, end double, rise double")


def climb_cost_s(start: Column, end: Column, rise: Column) -> Column:
    """Seconds a climb costs beyond its riding time: its grade over the free one, steepened, by its metres past the kick."""
    over = F.greatest(F.when(end > start, rise / (end - start)).otherwise(0.0) - FREE_GRADE, F.lit(0.0))
    past = F.greatest(end - start - CLIMB_KICK_M, F.lit(0.0))
    return F.when(rise > 0, COST_S_PER_M * over * (1 + over / STEEPENING) * past * (1 + past / SUSTAIN_M)).otherwise(0.0)


def climbed_along(samples: DataFrame, runs: DataFrame, route: str, along: str) -> DataFrame:
    """Adds climbed: metres into the climb that a sample is on, 0 where it is on none. runs: climb_runs, of which only
    climbs count; those of a route don't overlap, so the last that began decides."""
    ups = runs.where("rise > 0").select(F.col("route").alias(route), F.col("start").alias(along), F.col("end").alias("__end"), F.col("start").alias("__start"))
    both = samples.withColumn("__row", F.lit(1)).unionByName(ups.withColumn("__row", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(route).orderBy(along, "__row").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__row") == 0, F.struct("__start", "__end")), ignorenulls=True).over(w)
    placed = both.withColumn("__on", last).where("__row = 1")
    climbed = F.when(F.col(along) <= F.col("__on.__end"), F.col(along) - F.col("__on.__start")).otherwise(0.0)
    return placed.withColumn("climbed", climbed).select(*samples.columns, "climbed")


def speed_ratio(grade: Column, climbed: Column) -> Column:
    """Share of the level speed that a group keeps uphill, reached over the kick."""
    full = F.greatest(1 / (1 + CLIMB_SLOWING * (grade - FREE_CLIMB_GRADE)), F.lit(MIN_SPEED))
    return F.when(grade > FREE_CLIMB_GRADE, 1 - (1 - full) * F.least(F.greatest(climbed, F.lit(0.0)) / CLIMB_KICK_M, F.lit(1.0))).otherwise(1.0)


def grade_factor(grade: Column, climbed: Column) -> Column:
    """Share of the level flow that a grade leaves; 1 where it isn't known."""
    spaced = F.when(grade < -BRAKE_GRADE, F.greatest(1 / (1 + SPACING * (-grade - BRAKE_GRADE)), F.lit(MIN_SPACING))).otherwise(1.0)
    return F.coalesce(speed_ratio(grade, climbed) * spaced, F.lit(1.0))


def revisits(points: DataFrame, route: str, order: str, along: str, x: str, y: str, near: float = REVISIT_M, apart: float = REVISIT_ALONG_M) -> DataFrame:
    """(route, revisits): how often a route comes back within `near` of itself, more than `apart` metres later. Points with
    such a partner are flagged; two flagged stretches, out and back, are one revisit."""
    p = points.select(route, order, along, x, y)
    other = with_cells(p.select(F.col(route).alias("__r"), F.col(order).alias("__o"), F.col(along).alias("__a"), F.col(x).alias("__x"), F.col(y).alias("__y")), "__x", "__y", near)
    pairs = with_cells(p, x, y, near, around=True).join(other.withColumnRenamed("__r", route), [route, "cell"])
    d2 = (F.col(x) - F.col("__x")) ** 2 + (F.col(y) - F.col("__y")) ** 2
    hit = pairs.where((d2 < near * near) & (F.abs(F.col("__a") - F.col(along)) > apart)).select(route, order).distinct().withColumn("__hit", F.lit(1))
    w = Window.partitionBy(route).orderBy(order)
    flagged = p.join(hit, [route, order], "left").withColumn("__now", F.coalesce("__hit", F.lit(0)))
    begins = flagged.withColumn("__new", (F.col("__now") == 1) & (F.coalesce(F.lag("__now").over(w), F.lit(0)) == 0))
    return begins.groupBy(route).agg(F.floor(F.count_if("__new") / 2).cast("long").alias("revisits"))


def bends(points: DataFrame, route: str, order: str, x: str, y: str) -> DataFrame:
    """(route, length, degrees, per_100m): heading changes summed over a line's vertices, spread over at least MIN_SPAN_M.
    Steps under MIN_STEP_M have no heading."""
    w = Window.partitionBy(route).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    steps = points.select(route, order, F.sqrt(dx * dx + dy * dy).alias("step"), F.atan2(dy, dx).alias("heading"))
    known = F.when(F.col("step") >= MIN_STEP_M, F.col("heading"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turn = F.abs(F.degrees(F.pmod(known - before + F.pi(), 2 * F.pi()) - F.pi()))
    sums = steps.withColumn("turn", turn).groupBy(route).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), F.coalesce(F.sum("turn"), F.lit(0.0)).alias("degrees"))
    return sums.withColumn("per_100m", F.when(F.col("length") > 0, F.col("degrees") / F.greatest("length", F.lit(MIN_SPAN_M)) * 100).otherwise(0.0))


def hill_factors(pieces: DataFrame, windows: DataFrame, route: str, coefficient: float, width: float = 300.0) -> DataFrame:
    """pieces(route, start, end, ...), windows(route, w_start, w_end, extra per metre) -> pieces with factor:
    1 + coefficient * the extra of the windows over a piece, shared by overlap, per metre of it."""
    met = interval_overlap_join(pieces.select(route, "start", "end"), windows.select(route, "w_start", "w_end", "extra"), [route], ("start", "end"), ("w_start", "w_end"), width)
    shared = met.groupBy(route, "start", "end").agg(F.sum(F.col("extra") * (F.least("end", "w_end") - F.greatest("start", "w_start")) / (F.col("end") - F.col("start"))).alias("__x"))
    return pieces.join(shared, [route, "start", "end"], "left").withColumn("factor", 1 + coefficient * F.coalesce("__x", F.lit(0.0))).drop("__x")


def detour_level(route_m: Column, direct_m: Column) -> Column:
    """note, warning or strong where a route is longer than the direct one by more than the allowance."""
    allowed = F.greatest(direct_m * SILENT_RATIO, direct_m + SILENT_EXTRA_M)
    level = F.when(route_m > direct_m * STRONG_RATIO, "strong").when(route_m > direct_m * NOTE_RATIO, "warning").otherwise("note")
    return F.when((direct_m > 0) & (route_m > 0) & (route_m > allowed), level)


def crossings(samples: DataFrame, route: str, order: str, along: str, area: str, keep: str, least: float = MIN_CROSSING_M) -> DataFrame:
    """(route, area, start, end, kept) of the stretches of a route inside one area, in order; those shorter than
    `least` go unless a sample of them is marked to keep."""
    w = Window.partitionBy(route).orderBy(order)
    new = F.when(F.lag(area).over(w).eqNullSafe(F.col(area)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = samples.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy(route, "__run", area).agg(F.min(along).alias("start"), F.max(along).alias("end"), F.bool_or(keep).alias("kept"))
    return found.where(F.col(area).isNotNull() & (F.col("kept") | (F.col("end") - F.col("start") >= least))).drop("__run")


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line stay so that none left out is further than tolerance from the line that remains."""
    keep = np.zeros(len(points), bool)
    if len(points):
        keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, base = points[a + 1 : b], points[b] - points[a]
        size = float(base @ base)
        t = np.clip((p - points[a]) @ base / size, 0, 1) if size else np.zeros(len(p))
        away = np.linalg.norm(p - points[a] - t[:, None] * base, axis=1)
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(points: DataFrame, route: str, order: str, x: str, y: str, tolerance: float) -> DataFrame:
    """The points of each line that stay (Douglas and Peucker). One line's points go to one task."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(order)
        return batch[simplified(batch[[x, y]].to_numpy(float), tolerance)]

    return points.groupBy(route).applyInPandas(run, points.schema)


def _letters(number: Column) -> Column:
    """A number of a polyline: its bits doubled, all turned over if it is negative, five a letter, the lowest first."""
    bits = F.when(number < 0, -2 * number - 1).otherwise(2 * number)
    chunk = lambda i: F.shiftright(bits, 5 * i)
    letter = lambda i: F.when((chunk(i) > 0) | F.lit(i == 0), F.char((chunk(i).bitwiseAND(F.lit(31)) + F.when(chunk(i + 1) > 0, 32).otherwise(0) + 63).cast("int"))).otherwise("")
    return F.concat(*[letter(i) for i in range(7)])


def polylines(points: DataFrame, route: str, order: str, lon: str, lat: str, digits: int = 6) -> DataFrame:
    """(route, line): each route as an encoded polyline, latitude before longitude."""
    w = Window.partitionBy(route).orderBy(order)
    scaled = lambda c: F.round(F.col(c) * 10**digits).cast("long")
    step = lambda c: scaled(c) - F.coalesce(F.lag(scaled(c)).over(w), F.lit(0).cast("long"))
    each = points.select(route, order, F.concat(_letters(step(lat)), _letters(step(lon))).alias("code"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "code"))), lambda s: s["code"])
    return each.groupBy(route).agg(F.array_join(parts, "").alias("line"))
