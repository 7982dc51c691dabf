"""Streams: fixed windows, presence sessions, last-N state, budgets, last-good copies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadweave.operators.windows import COUNTS_KEPT, EMPTY_USUAL, SHRUNK_SHARE, SHRUNK_USUAL, USUAL_AFTER


def window_counts(events: DataFrame, ts: str, keys: list[str], width: str, late: str | None = None) -> DataFrame:
    """Events in each fixed window of each key; with `late`, windows close that long after their end."""
    if late:
        events = events.withWatermark(ts, late)
    counted = events.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def presence(events: DataFrame, ts: str, keys: list[str], idle: str, late: str | None = None) -> DataFrame:
    """Sessions that end when a key is idle that long."""
    if late:
        events = events.withWatermark(ts, late)
    found = events.groupBy(F.session_window(ts, idle), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def _doubt(counts: list[int], found: int) -> str | None:
    usual = sorted(counts)[len(counts) // 2] if len(counts) >= USUAL_AFTER else None
    if usual is not None and found == 0 and usual >= EMPTY_USUAL:
        return "empty"
    if usual is not None and found and usual >= SHRUNK_USUAL and found < usual * SHRUNK_SHARE:
        return "shrunk"
    return None


def remembered(reads: DataFrame) -> DataFrame:
    """reads(feed string, at long, found long) -> (feed, at, found, doubt): each read against the last
    eight kept; a doubted read that is taken starts the counts again."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts = list(state.get[0]) if state.exists else []
        rows = []
        for r in pd.concat(list(batches)).sort_values(["at", "found"]).itertuples():
            why = _doubt(counts, r.found)
            counts = [int(r.found)] if why else [*counts, int(r.found)][-COUNTS_KEPT:]
            rows.append((key[0], r.at, r.found, why))
        state.update((counts,))
        yield pd.DataFrame(rows, columns=["feed", "at", "found", "doubt"])

    return reads.groupBy("feed").applyInPandasWithState(step, "feed string, at long, found long, doubt string", "counts array<long>", "append", GroupStateTimeout.NoTimeout)


def take_if_fits(asks: DataFrame, limit: int, width: int) -> DataFrame:
    """asks(client string, at long seconds, cost long) -> with taken: within a fixed window the costs taken
    never pass the limit; a refused ask counts nothing."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, used = state.get if state.exists else (-1, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values(["at", "cost"]).itertuples():
            if r.at // width != window:
                window, used = r.at // width, 0
            taken = used + r.cost <= limit
            used += r.cost if taken else 0
            rows.append((key[0], r.at, r.cost, taken))
        state.update((int(window), int(used)))
        yield pd.DataFrame(rows, columns=["client", "at", "cost", "taken"])

    return asks.groupBy("client").applyInPandasWithState(step, "client string, at long, cost long, taken boolean", "window long, used long", "append", GroupStateTimeout.NoTimeout)


def keep_last_good(stream: DataFrame, path: str, key: str, order: str):
    """Writes, batch by batch, the latest good row of each key to a table at path/batch; keys absent from a batch keep
    theirs. A batch needs the table of the one before and fails without it, rather than lose what was known. Tables
    before that one are removed."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.unionByName(spark.read.parquet(f"{path}/{n - 1}")) if n else batch
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/{n}")
        if n > 1:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n - 2}")
            old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)

    return stream.writeStream.foreachBatch(merge).trigger(availableNow=True)


def status(read_at: Column, now: Column, old_s: int, failed_s: int) -> Column:
    """ok, old or failed, by the age of the last read; never read: failed."""
    age = F.unix_timestamp(now) - F.unix_timestamp(read_at)
    return F.when(read_at.isNull() | (age > failed_s), "failed").when(age > old_s, "old").otherwise("ok")


def frozen(updated: Column, now: Column, after_s: int = 3 * 24 * 3600) -> Column:
    """Whether a publisher's own date is further back than three days; unknown dates aren't judged."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(updated) > after_s, F.lit(False))
