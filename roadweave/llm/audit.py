"""Filter interaction audit: all orders of a set of filters, run over the trie of their prefixes.

A trie of all orders is walked depth first. A node is the set of filters applied so far, whatever their order, so each set
is run once: its survivors are the parent's survivors less those that fail one filter, held by persist() until all nodes
below are done, and its edges count what each further filter removes from them. The counts of a node are written to the
shared folder; orders and steps are put together from them afterwards. With k filters there are 2^k nodes, k! orders.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.session import cut, shared_dir

HOT = 200  # texts with so many rows that each may hold over a 201st of the table are looked up in a broadcast


def later_copies(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `copy`: whether a row of the same key has a smaller `order` (null orders are never copies, nor smaller).
    Keys of many rows: the HOT largest groups are met by a broadcast of a row each, so no shuffled key of the join has
    more than a 201st of the rows."""
    firsts = cut(rows.where(F.col(order).isNotNull()).groupBy(key).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).where("__n > 1"))
    hot = firsts.orderBy(F.desc("__n"), key).limit(HOT).select(key, "__first")
    cold = firsts.join(F.broadcast(hot.select(key)), key, "left_anti").select(key, "__first")
    often = rows.join(F.broadcast(hot), key)
    seldom = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return often.unionByName(seldom).withColumn("copy", F.coalesce(F.col(order) > F.col("__first"), F.lit(False))).drop("__first")


def edges(rows: DataFrame, failing: list[str], part: str, losses: list[str]) -> DataFrame:
    """rows(part, a boolean column for each filter and each loss) -> (part, state, alive, filter, removed, one column for
    each loss): what filter (its number) removes from the survivors of the filters in state (a bit each)."""
    k, seen = len(failing), set()
    folder = f"{shared_dir(rows.sparkSession)}/audit-{uuid.uuid4().hex}"
    number = lambda c: F.sum(c.cast("long"))

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        ahead = [i for i in range(k) if not state >> i & 1]
        if not ahead:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        edge = lambda i: F.struct(F.lit(i).alias("filter"), number(F.col(failing[i])).alias("removed"), *[number(F.col(failing[i]) & F.col(c)).alias(c) for c in losses])
        counted = survivors.groupBy(part).agg(F.count("*").alias("alive"), F.array(*[edge(i) for i in ahead]).alias("edges"))
        counted.write.parquet(f"{folder}/state={state}")
        for i in ahead:
            if state | 1 << i not in seen:
                visit(state | 1 << i, survivors.where(~F.col(failing[i])))
        survivors.unpersist()

    visit(0, rows)
    found = rows.sparkSession.read.parquet(folder)
    return found.select(part, "state", "alive", F.explode("edges").alias("e")).select(part, "state", "alive", "e.*")


def audit(rows: DataFrame, failing: dict[str, Column], part: str = "part", losses: dict[str, Column] | None = None) -> DataFrame:
    """One row for each part, order of the filters and step: (part, filter_order, step, kept, removed, redundant,
    unique_fails, <each loss>_lost, shapley), all counts of rows of the part, zeros included.

    failing: for each filter, named by a letter, whether a row fails it. losses: rows whose removal is counted apart.
    Null conditions are false; a null part is the empty string. Rows are counted as they come, repeated ones too; other
    columns aren't read; an empty table gives an empty result. Each order has a row a step, so 6 filters are the most
    that make sense."""
    losses = losses or {}
    letters, k = list(failing), len(failing)
    fail, lost = [f"fail_{i}" for i in range(k)], [f"lost_{i}" for i in range(len(losses))]
    sure = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    narrow = rows.select(F.coalesce(F.col(part), F.lit("")).alias("part"), *[sure(c).alias(n) for n, c in zip(fail, failing.values())], *[sure(c).alias(n) for n, c in zip(lost, losses.values())])
    counted = edges(cut(narrow), fail, "part", lost)
    full = (1 << k) - 1
    all_edges = [(s, i) for s in range(full + 1) for i in range(k) if not s >> i & 1]
    grid = counted.select("part").distinct().withColumn("g", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("filter")) for s, i in all_edges]))).select("part", "g.*")
    whole = cut(grid.join(counted, ["part", "state", "filter"], "left").fillna(0))
    orders = factorial(k)
    weight = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)).cast("long") for s in range(k)]), F.bit_count("state") + 1)
    at = lambda state: F.max(F.when(F.col("state") == state, F.col("removed")))
    single = F.lit(full).bitwiseXOR(F.expr("shiftleft(1, filter)"))
    sums = whole.groupBy("part", "filter").agg(at(F.lit(0)).alias("fails"), at(single).alias("unique_fails"), F.sum(F.col("removed") * weight).alias("shapley"))
    steps = [("".join(letters[i] for i in o), n + 1, sum(1 << i for i in o[:n]), o[n]) for o in permutations(range(k)) for n in range(k)]
    assert len(steps) == orders * k
    plan = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    told = whole.join(sums, ["part", "filter"]).join(F.broadcast(plan), ["state", "filter"])
    return told.select(
        "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        *[F.col(n).alias(f"{c}_lost") for n, c in zip(lost, losses)], "shapley",
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang), labels(doc_id, quality, toxic) -> (part, A to E, good, toxic): the five conditions on each
    whole text (null: empty). A: under 100 words; B: distinct words under 80% of the words; C: over 10% of the code
    points in A-Z; D: one of #$%&*|; E: the text of a smaller doc_id. Ids without labels are neither good nor toxic;
    of several labels of an id any counts. A row with a null id is no copy."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    distinct = F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    rows = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"), (F.size(words) < 100).alias("A"),
        (100 * distinct < 80 * F.size(words)).alias("B"), (100 * capitals > 10 * F.length(text)).alias("C"), text.rlike(r"[#$%&*|]").alias("D"),
    )
    marks = labels.groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    return later_copies(cut(rows), "digest", "doc_id").withColumnRenamed("copy", "E").join(marks, "doc_id", "left")


def orders_of_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five conditions of `judged`, by language."""
    failing = {c: F.col(c) for c in "ABCDE"}
    return audit(judged(docs, labels), failing, "part", {"good": F.col("good"), "toxic": F.col("toxic")})
