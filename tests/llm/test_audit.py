import re
from itertools import permutations

from pyspark.sql import functions as F

from roadweave.llm import audit


def told(docs, labels):
    """Every order run over every document, from the definitions."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    parts = {}
    for d, t, lang in docs:
        t = t or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        fails = {c for c, f in zip("ABCDE", (len(w) < 100, 100 * len({*w}) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and first[t] < d)) if f}
        mark = lambda k: any(x[k] == 1 for x in labels if x[0] == d and d is not None)
        parts.setdefault(lang or "", []).append((fails, mark(1), mark(2)))
    rows, shapley = [], {}
    for part, all_ in parts.items():
        for order in permutations("ABCDE"):
            alive = all_
            for step, c in enumerate(order):
                gone = [r for r in alive if c in r[0]]
                alive = [r for r in alive if c not in r[0]]
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
                rows.append((part, "".join(order), step + 1, len(alive), len(gone), sum(c in r[0] for r in all_) - len(gone), sum(r[0] == {c} for r in all_), sum(r[1] for r in gone), sum(r[2] for r in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in rows)


def test_against_definitions(spark):
    words = " ".join(f"w{i}" for i in range(120))
    docs = [(1, None, "en"), (2, "", None), (2, "", None), (None, "a #", ""), (3, words, "de"), (4, words, "de"), (5, words.upper(), "de"), (6, words + " $", "de"), (6, "other", "de")]
    docs += [(7, "same same " * 60_000, "fr"), (8, "same same " * 60_000, "fr"), (9, "É" * 9 + "A", "fr"), (10, "É" * 8 + "A", "fr")] + [(20 + i, "copy", "en") for i in range(40)]
    labels = [(1, 1, 0), (2, 1, None), (2, 0, 1), (4, None, 1), (25, 1, 1), (None, 1, 1), (99, 1, 1)]
    df = spark.createDataFrame([(*d, "x", True) for d in docs], "doc_id long, text string, lang string, kept string, good boolean").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = audit.orders_of_filters(df, marks)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == told(docs, labels)
    assert audit.orders_of_filters(df.limit(0), marks).collect() == []
    assert audit.orders_of_filters(df.limit(3), marks.limit(0)).count() > 0


def test_each_set_of_filters_runs_once(spark, monkeypatch):
    """32 nodes less the last, which has no edge, are counted; nothing stays persisted."""
    rows = spark.range(50).select(*[(F.col("id") % k == 0).alias(f"f{k}") for k in (2, 3, 5)])
    counted, df_type, held = [], type(rows), {*spark.sparkContext._jsc.getPersistentRDDs()}
    persist = df_type.persist
    monkeypatch.setattr(df_type, "persist", lambda self, *a: counted.append(1) or persist(self, *a))
    got = audit.audit(rows.withColumn("part", F.lit("p")), {f"{k}": F.col(f"f{k}") for k in (2, 3, 5)}).collect()
    assert len(counted) == 7 and len(got) == 18 and {r.shapley for r in got if r.filter_order[r.step - 1] == "2"} == {sum(r.removed for r in got if r.filter_order[r.step - 1] == "2")}
    assert {*spark.sparkContext._jsc.getPersistentRDDs()} <= held


def test_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(audit, "HOT", 2)
    rows = [("a", i) for i in range(300)] + [("b", i) for i in range(50)] + [("c", 7), ("c", 9), ("d", 1), ("c", None), ("a", 0)]
    df = spark.createDataFrame([r for r in rows], "k string, i long").repartition(4)
    got = sorted((r.k, -1 if r.i is None else r.i, r.copy) for r in audit.later_copies(df, "k", "i").collect())
    least = {"a": 0, "b": 0, "c": 7, "d": 1}
    assert got == sorted((k, -1 if i is None else i, i is not None and i > least[k]) for k, i in rows)
