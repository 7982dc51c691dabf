from roadweave.llm import mixing


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target int")
    return mixing.mix(df).collect()


def test_caps_and_totals(spark):
    rows = [(i, "w " * (i % 7 + 1), "big" if i % 3 else None, "x", 1) for i in range(300)] + [(900, "a b\x0bc", "small", "x", 1), (901, None, "none", "x", 1), (902, "", "small", "x", 1), (900, "a b\x0bc", "small", "x", 1)]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in got}
    assert abs(sum(t for t, _ in targets.values()) - total) < 1e-6
    for s, (t, size) in targets.items():
        assert t <= 3 * size
        assert sum(r["taken"] for r in got if r["source"] == s) == int(t)
    assert targets["small"] == (18.0, 6)
    assert all(r["taken"] <= 3 * r["size"] and 0 <= r["position"] <= 1 for r in got)
    assert got and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed(spark, rows)), key=str)


def test_empty(spark):
    assert mixed(spark, []) == []
