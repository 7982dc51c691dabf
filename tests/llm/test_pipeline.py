import re
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from roadweave.llm import quality, tokens
from roadweave.session import table
from tests.llm.test_decontamination import brute as leaks_of

SF = "/root/testdata/sf0.01"


def stage(spark, k, docs):
    return corpus_pipeline.STAGES[k][1](spark, docs, SF)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def copies_of(rows):
    """Smallest id of each group, by the similarity of all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in rows}
    where, parent = defaultdict(set), {d: d for d in sets}
    for d, s in sets.items():
        for g in s or {None}:
            where[g].add(d)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(a, b) for ds in where.values() if len(ds) < 300 for a in ds for b in ds if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) or not sets[a] and not sets[b]:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: root(d) for d in sets}


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}

    good = stage(spark, 0, docs).cache()
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    marked = sorted((d for d in labels if zlib.crc32(str(d).encode()) % 5 and d in texts), key=lambda d: (d * 2654435761 % 2**32, (texts[d] or "").encode()))
    w, bias, a, b = quality.train([quality.features((texts[d] or "").encode()) for d in marked], np.array([labels[d] == 1 for d in marked], bool))
    score = {d: 1 / (1 + np.exp(-(a * quality.margin(quality.features((t or "").encode()), w, bias) + b))) for d, t in texts.items()}
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns and kept == {d for d, s in score.items() if s >= 0.3}
    clean = [d for d, q in labels.items() if q == 1 and d in texts]
    assert sum(d in kept for d in clean) > 0.97 * len(clean)

    single = stage(spark, 1, good).cache()
    groups = copies_of([(d, texts[d]) for d in kept])
    left = {r.doc_id for r in single.collect()}
    assert single.columns == columns and left == {d for d, g in groups.items() if d == g} and len(left) < len(kept)

    apart = stage(spark, 2, single).cache()
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    near = [(d, texts[d]) for d in left if any(plain(u)[:60] in plain(texts[d]) or plain(u)[-60:] in plain(texts[d]) for _, u in items)]
    leaked = {d for d, _ in leaks_of(near, items)}
    assert apart.columns == columns and leaked and {r.doc_id for r in apart.collect()} == left - leaked

    mixed = stage(spark, 3, apart).cache()
    rows = mixed.collect()
    words = lambda t: len((t or "").encode().split())
    size, taken = defaultdict(int), defaultdict(int)
    for r in apart.collect():
        size[r.source] += words(r.text)
    for r in rows:
        taken[r.source] += words(r.text)
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    whole, sources = sum(size.values()), sorted(size)
    weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(sources)}, {}, set(sources)
    while open_:
        level = (whole - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        target |= {s: 3 * size[s] for s in full} or {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    assert mixed.columns == columns and all(abs(taken[s] - target[s]) <= 1 for s in sources)

    t, at, want = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json")), 0, []
    for r in sorted(rows, key=lambda r: (r.doc_id, r.text.encode())):
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, stage(spark, 4, mixed).collect()), key=lambda r: r[1]) == want


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", "a", 3), (5, "same words here", "en", "b", 15), (6, "Same  WORDS here", "en", "b", 16), (5, "same words here", "en", "b", 15)], "doc_id long, text string, lang string, source string, n_chars long")
    for k in range(4):
        for df in (docs, docs.limit(0)):
            out = stage(spark, k, df)
            rows = out.collect()
            assert out.columns == docs.columns and len(rows) <= 3 * df.count()
    left = stage(spark, 1, docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in left) == [(False, 0), (True, 1), (True, 5)]


def test_repeated_ids_null_ids_and_further_columns(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, "x", "mine"), (None, "y", "mine"), (7, one, "p"), (7, two, "q"), (7, one, "r"), (8, two + " more", "s"), (9, one, "t")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t), "body", 5, 0.25) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, turn int, quality_score double")
    first, second = (sorted(map(tuple, stage(spark, 1, docs).collect()), key=str) for _ in range(2))
    assert first == second and sorted(((r[0], r[1]) for r in first), key=str) == sorted([(None, "x"), (None, "y"), (7, one), (7, two)], key=str)
    kept = stage(spark, 0, docs)
    assert kept.columns == docs.columns and all(r.quality_score == 0.25 for r in kept.collect())
    for k in (2, 3):
        out = stage(spark, k, docs)
        assert out.columns == docs.columns and {(r.node, r.turn) for r in out.collect()} == {("body", 5)}
