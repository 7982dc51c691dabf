"""What is left of many: lines that don't mostly lie on longer ones, and the samples of a profile that show its shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.operators.matching import _turn, line_segments, near_lines, way_probes
from roadweave.session import cut_spread as cut
from roadweave.session import spread

# Metres and share of overlap, metres between places; samples sent of a profile.
OVERLAP_M, OVERLAP_SHARE, STEP_M = 25.0, 0.5, 10.0
MOST_SAMPLES, PICKS = 2000, 4


def without_overlaps(lines: DataFrame, reach: float = OVERLAP_M, share: float = OVERLAP_SHARE, step: float = STEP_M) -> DataFrame:
    """lines(line long, length, pts, both: may be ridden either way) -> those left when each is taken, longest first (ties: the
    smaller line), unless `share` of its places lie within reach of lines taken before it that run the same way there.

    In rounds: a line is decided once all longer ones near it are, which equals one pass in order; places are met in cells."""
    lines = spread(lines.where(F.size("pts") >= 2))
    rank = F.struct((-F.col("length")).alias("l"), F.col("line").alias("i"))
    ranks = lines.select("line", rank.alias("rank"), F.coalesce("both", F.lit(False)).alias("both"))
    probes = cut(way_probes(lines.select(F.col("line").alias("way"), "pts"), step, 0.0))
    near = near_lines(probes, line_segments(lines.select(F.col("line").alias("feature"), "pts")), reach).where("way != feature")
    mine, other = ranks.toDF("way", "rank", "both"), ranks.toDF("feature", "rank2", "both2")
    met = near.join(mine, "way").join(other, "feature").where((F.col("rank2") < F.col("rank")) & (F.col("both") | F.col("both2") | (_turn(F.col("heading"), F.col("fheading")) < 90)))
    hits = cut(met.select("way", "slot", "feature"))
    places = probes.groupBy("way").agg(F.first("probes").alias("places"))
    open_, kept = cut(lines.select(F.col("line").alias("way")).join(places, "way", "left")), None
    while not open_.isEmpty():
        waits = hits.join(open_.select(F.col("way").alias("feature")), "feature", "left_semi").select("way").distinct()
        ready = open_.join(waits, "way", "left_anti")
        covered = ready.select("way").join(hits, "way")
        covered = covered.limit(0) if kept is None else covered.join(kept.select(F.col("way").alias("feature")), "feature", "left_semi")
        n = covered.groupBy("way").agg(F.countDistinct("slot").alias("n"))
        taken = cut(ready.join(n, "way", "left").where(F.coalesce(F.col("n"), F.lit(0)) < share * F.coalesce("places", F.lit(1))).select("way"))
        open_ = cut(open_.join(waits, "way", "left_semi"))
        kept = taken if kept is None else kept.unionByName(taken)
    return lines.limit(0) if kept is None else lines.join(kept.select(F.col("way").alias("line")), "line", "left_semi")


def picks(height: np.ndarray, grade: np.ndarray, window: int) -> np.ndarray:
    """Of each window of samples the steepest, the highest, the lowest and the first without a height; and both ends."""
    n = len(height)
    rows = -(-n // window)
    padded = lambda v, fill: np.append(v, np.full(rows * window - n, fill)).reshape(rows, window)
    gap = np.isnan(height)
    start = np.arange(rows) * window
    steep = np.where(np.isnan(grade), -1.0, np.abs(grade))
    found = [start + padded(steep, -2.0).argmax(1), start + padded(np.where(gap, -np.inf, height), -np.inf).argmax(1), start + padded(np.where(gap, np.inf, height), np.inf).argmin(1)]
    gaps = padded(gap.astype(float), 0.0)
    found.append((start + gaps.argmax(1))[gaps.any(1)])
    return np.unique(np.concatenate([*found, [0, n - 1]])).clip(0, n - 1)


def thinned(samples: DataFrame, route: str, order: str, height: str, grade: str, most: int = MOST_SAMPLES) -> DataFrame:
    """samples with those left out that a picture of the profile doesn't need: a route of up to `most` stays whole; of a longer
    one each window of samples keeps its steepest, highest and lowest and its first gap, with windows as narrow as `most`
    allows. A route's samples are one task's."""

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) <= most:
            return pdf
        pdf = pdf.sort_values(order)
        h, g = pdf[height].to_numpy(float), pdf[grade].to_numpy(float)
        low, high = -(-len(pdf) // most), -(-len(pdf) * PICKS // max(most - 2, 1))
        best = picks(h, g, high)
        while low < high:
            mid = (low + high) // 2
            now = picks(h, g, mid)
            if len(now) <= most:
                high, best = mid, now
            else:
                low = mid + 1
        return pdf.iloc[best]

    return samples.groupBy(route).applyInPandas(thin, samples.schema)
