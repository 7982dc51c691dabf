import math
import zlib
from collections import Counter

import duckdb
import numpy as np

from roadweave.llm import language
from roadweave.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op11_language"](spark, sf).collect()}
    docs = duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in got.items())
    out = [(lang, got[d].lang_pred) for d, lang in docs if got[d].held_out]
    right, all_ = Counter(a for a, b in out if a == b), Counter(a for a, _ in out)
    print({k: right[k] / all_[k] for k in all_})
    assert all(right[k] / all_[k] > 0.97 for k in all_) and {b for _, b in out} == {*all_}
    assert sum(r.distant for r in got.values()) < 0.05 * len(got)


def test_buckets_and_weights_by_hand():
    ids, counts = language.buckets("Ab, ab! 1")
    text = b" ab ab "
    code = lambda n, x: (x * 2654435761) % 2**32 >> (32 - language.BITS)
    want = Counter(text) + Counter(code(2, a << 8 | b | 1 << 24) for a, b in zip(text, text[1:])) + Counter(code(3, a << 16 | b << 8 | c) for a, b, c in zip(text, text[1:], text[2:]))
    assert dict(zip(ids.tolist(), counts.tolist())) == dict(want)
    idf = np.linspace(1, 2, language.SIZE, dtype=np.float32)
    plain = [math.log(1 + c) * idf[i] for i, c in zip(ids, counts)]
    assert np.allclose(language.weigh(ids, counts, idf), np.array(plain) / math.sqrt(sum(x * x for x in plain)))


def test_clusters_settle():
    """Every row belongs to its nearest centroid, which is the mean of its rows on the sphere; apart groups are found."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 0.05, (30, 20)) + np.eye(20)[k] for k in (0, 5, 9)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres, own = language.cluster(x, most=3)
    assert {tuple(sorted({*own[a : a + 30]})) for a in (0, 30, 60)} == {(0,), (1,), (2,)}
    for k in range(3):
        mean = x[own == k].mean(0)
        assert np.allclose(centres[k], mean / np.linalg.norm(mean), atol=1e-6)


def test_document_frequencies_cover_every_row(spark):
    texts = ["one two", "two three", "two two", "four"] * 7
    total, seen = language.frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    want = np.zeros(language.SIZE, int)
    for t in texts:
        want[language.buckets(t)[0]] += 1
    assert total == len(texts) and (seen == want).all()


def test_predictions_against_all_centroids(spark):
    """Predictions are the best of the plain cosines with every centroid; rejection gives the unknown language."""
    texts = {"x": ["alpha beta gamma", "beta gamma alpha", "gamma gamma alpha beta"], "y": ["uno dos tres", "dos tres uno", "tres uno dos"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    more = docs.unionByName(spark.createDataFrame([(90, "qqq www kkk", "x"), (91, "gamma uno", "x")], docs.schema))
    for r in language.identify(more, model).collect():
        ids, counts = language.buckets(r.text)
        v = np.zeros(language.SIZE)
        v[ids] = language.weigh(ids, counts, model["idf"])
        cosines = v @ model["centres"]
        assert math.isclose(r.score, max(cosines.max(), 0), abs_tol=1e-5) and r.lang_pred == model["langs"][int(cosines.argmax())]
        assert r.distant == (cosines.max() < model["least"][int(cosines.argmax())])
    assert {r.doc_id: r.lang_pred for r in language.identify(more, model, reject=True).collect()}[90] == "und"


def test_sample_bound_and_reruns(spark):
    rows = [(i, f"word{chr(97 + i % 26)} and text {chr(97 + i % 7)} of row", "a") for i in range(300)] + [(i, "autre phrase ici", "b") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    one, two = language.fit(docs, sample=5), language.fit(docs.repartition(2), sample=5)
    assert one["langs"] == two["langs"] and np.allclose(one["centres"], two["centres"]) and {*one["langs"]} == {"a", "b"}


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " 12 %& ", "y"), (4, "mot", None), (None, "word word", "x"), (5, "autre " * 60_000, "y"), (5, "autre " * 60_000, "y")]
    docs = spark.createDataFrame([(*r, 0.5, "kept") for r in rows], "doc_id long, text string, lang string, score double, extra string")
    got = sorted((tuple(r) for r in language.identify(docs, language.fit(docs)).select("doc_id", "lang_pred", "score", "extra").collect()), key=str)
    assert len(got) == len(rows) and {g[3] for g in got} == {"kept"}
    assert all(g[1] == "und" and g[2] == 0 for g in got if g[0] in (1, 2, 3)) and {g[1] for g in got if g[0] in (4, None, 5)} <= {"x", "y"}
    assert [g[1] for g in got if g[0] == 5] == ["y", "y"]
    empty = docs.limit(0)
    assert language.identify(empty, language.fit(empty)).collect() == []
    assert {r.lang_pred for r in language.identify(docs, language.fit(empty)).collect()} == {"und"}
