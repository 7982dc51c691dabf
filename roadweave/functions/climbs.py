"""Categorised climbs: rises with short dips and flats inside them, trimmed to where they climb."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Score thresholds of the categories; least length and grade; dips, breaks and trims in metres.
CATEGORIES = (("HC", 80_000.0), ("1", 64_000.0), ("2", 32_000.0), ("3", 16_000.0), ("4", 8_000.0), ("5", 4_000.0))
LEAST_M, LEAST_GRADE = 500.0, 0.01
DIP_MIN_M, DIP_SHARE, DIP_MAX_M = 10.0, 0.20, 50.0
BREAK_MIN_M, BREAK_SHARE, BREAK_MAX_M, NOISE_M, BREAK_TOTAL = 400.0, 0.25, 1_600.0, 3.0, 2.0
TRIM_M = 300.0


class Rise:
    """A rise from a low sample: its top, and how the profile went on since."""

    def __init__(self, at: np.ndarray, e: np.ndarray, low: int):
        self.at, self.e, self.low = at, e, low
        self.reach(low)

    def reach(self, i: int) -> None:
        self.top, self.floor, self.level = i, self.e[i], self.at[i]  # level: where it last lay near its floor

    def goes_on(self, i: int) -> bool:
        """Takes sample i in; False if the rise has ended before it."""
        e = self.e[i]
        if e > self.e[self.top]:
            self.reach(i)
            return True
        gain, length = self.e[self.top] - self.e[self.low], self.at[self.top] - self.at[self.low]
        if e < self.e[self.low] or self.e[self.top] - e > min(DIP_MAX_M, max(DIP_MIN_M, DIP_SHARE * gain)):
            return False
        self.floor = min(self.floor, e)
        if e <= self.floor + NOISE_M:
            self.level = self.at[i]
        rest = min(BREAK_MAX_M, max(BREAK_MIN_M, BREAK_SHARE * length))
        return self.level - self.at[self.top] <= rest and self.at[i] - self.at[self.top] <= BREAK_TOTAL * rest


def rises(at: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """(low, top) of every rise; the next begins at the top of the one before, or lower."""
    up, out, low = np.flatnonzero(np.diff(e) > 0), [], 0
    while (k := np.searchsorted(up, low)) < len(up):
        rise = Rise(at, e, int(up[k]))
        for i in range(rise.low + 1, len(e)):
            if not rise.goes_on(i):
                break
        out.append((rise.low, rise.top))
        low = rise.top
    return out


def trimmed(at: np.ndarray, e: np.ndarray, low: int, top: int) -> tuple[int, int]:
    """The part of a rise that climbs: both ends move in while TRIM_M from them climb at under LEAST_GRADE, then sample by
    sample within TRIM_M, and the start goes to the lowest sample within TRIM_M of it."""

    def first(x, y):
        to = np.minimum(np.searchsorted(x, x + TRIM_M), len(x) - 1)
        run = x[to] - x
        return int(np.flatnonzero((run < TRIM_M) | (y[to] - y >= LEAST_GRADE * run))[0])

    def gentle_end(x, y):
        run = np.diff(x)
        slow = ((run <= 0) | (np.diff(y) < LEAST_GRADE * run)) & (x[1:] <= x[0] + TRIM_M)
        steep = np.flatnonzero(~slow)
        return int(steep[0]) if len(steep) else len(slow)

    mirrored = lambda a, b: (at[b] - at[a : b + 1][::-1], e[b] - e[a : b + 1][::-1])  # noqa: E731  the end as a start
    low += first(at[low : top + 1], e[low : top + 1])
    top -= first(*mirrored(low, top))
    low += gentle_end(at[low : top + 1], e[low : top + 1])
    top -= gentle_end(*mirrored(low, top))
    near = np.flatnonzero(at[low : top + 1] - at[low] <= TRIM_M)
    lowest = e[low : top + 1][near]
    return low + int(near[np.flatnonzero(lowest == lowest.min())[-1]]), top


def category(gain: float) -> str | None:
    """By the score, length times average grade in percent."""
    return next((name for name, over in CATEGORIES if gain * 100 > over), None)


def find_climbs(at: np.ndarray, e: np.ndarray) -> list[tuple[int, int, float, str]]:
    """(first sample, last sample, gain, category) of the categorised climbs of an unbroken profile, in order."""
    out = []
    for low, top in rises(at, e):
        a, b = trimmed(at, e, low, top)
        gain, length = float(e[b] - e[a]), float(at[b] - at[a])
        if b > a and length >= LEAST_M and gain >= LEAST_GRADE * length and category(gain):
            out.append((a, b, gain, category(gain)))
    return out


def climbs(samples: DataFrame, key: str = "chain", both: bool = False) -> DataFrame:
    """samples(key, along, height, ahead, back; whether it may be ridden that way) -> (key, reverse, start, end, gain, category,
    grade_pct): categorised climbs along each profile, with both also those met riding it from its end. start and end are
    metres along the profile, start being where the climb begins. Samples of null height break a profile; a climb with a
    sample that may not be ridden its way is left out. A profile is one task's; profiles are many and short next to it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, found = pdf.sort_values("along"), []
        known = pdf["height"].notna().to_numpy()
        for piece in np.split(np.arange(len(pdf)), np.flatnonzero(known[1:] != known[:-1]) + 1):
            if len(piece) < 2 or not known[piece[0]]:
                continue
            at, e = pdf["along"].to_numpy(float)[piece], pdf["height"].to_numpy(float)[piece]
            for reverse in (False, True)[: 1 + both]:
                x, y = (at[-1] - at[::-1], e[::-1]) if reverse else (at, e)
                free = pdf["back" if reverse else "ahead"].to_numpy(bool)[piece[::-1] if reverse else piece]
                for a, b, gain, name in find_climbs(x, y):
                    if free[a : b + 1].all():
                        start, end = (at[-1] - x[a], at[-1] - x[b]) if reverse else (x[a], x[b])
                        found.append((pdf[key].iloc[0], reverse, start, end, gain, name, round(100 * gain / abs(end - start), 1)))
        return pd.DataFrame(found, columns=[key, "reverse", "start", "end", "gain", "category", "grade_pct"])

    kind = dict(samples.dtypes)[key]
    rows = samples.select(key, F.col("along").cast("double").alias("along"), F.col("height").cast("double").alias("height"), F.coalesce("ahead", F.lit(True)).alias("ahead"), F.coalesce("back", F.lit(True)).alias("back"))
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, reverse boolean, start double, end double, gain double, category string, grade_pct double")


def stroke_samples(placed: DataFrame, samples: DataFrame) -> DataFrame:
    """placed(line, chain, place, forward, start; of chains.along_chains, with length), samples(line, along, height, oneway: 1, -1
    or null) -> climbs' samples along each chain. A sample at the joint of two lines is given once, of the line after."""
    on = samples.join(placed.select("line", "chain", "forward", "start", "length"), "line")
    along = F.col("start") + F.when(F.col("forward"), F.col("along")).otherwise(F.col("length") - F.col("along"))
    way = F.when(F.col("forward"), F.col("oneway")).otherwise(-F.col("oneway"))
    told = on.select("chain", F.round(along, 6).alias("along"), "height", "start", F.coalesce(way >= 0, F.lit(True)).alias("ahead"), F.coalesce(way <= 0, F.lit(True)).alias("back"))
    one = told.groupBy("chain", "along").agg(F.max(F.struct("start", "height")).alias("m"), F.bool_and("ahead").alias("ahead"), F.bool_and("back").alias("back"))
    return one.select("chain", "along", F.col("m.height").alias("height"), "ahead", "back")
