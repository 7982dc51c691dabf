import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from roadweave.llm import binary, tokens
from roadweave.session import table

ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \nb", "a\n b", "a\n\n b", "a \t b\r\n", "x y z", "x\x1cy \x1c z", "a　 b", "\n\n\n", "tab\tone two",
    "ΑΣ ΟΔΟΣ Σ", "İstanbul I'm you'll it's 'S", "é café e ́x", "日本語 テキスト 12345 ½²", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> x<|endoftext|>y",
    "a <|endoftext|> b", "x" * 3000, "🙂🙂 ok 🏳️‍🌈", "don't 'll 've", "a​b ﻿c", "%%% ### $$$ &&&***", "\x00\x01 \x7f",
]


def texts(n=400):
    rng = random.Random(1)
    parts = ["the", "ouer", "Ément", "12", "'s", " ", "  ", "\n", "\t", "ß", "Ş", ".", "<|endoftext|>", " ", "q" * 30, "中"]
    return ODD + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_counts_equal_the_library():
    t = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    c = tokens.Counter(tokens.tokenizer_path("word_bpe_49k.json"))
    for x in texts():
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_any_code_points():
    # new capitals, unassigned code points, marks after them
    path, rng = tokens.tokenizer_path("word_bpe_49k.json"), random.Random(8)
    t, c = Tokenizer.from_file(path), tokens.Counter(path)
    some = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    fuzz = ["".join(chr(rng.choice(some if rng.random() < 0.3 else range(32, 0x3000))) for _ in range(rng.randrange(1, 6))) for _ in range(6000)]
    for x in ["a\ua7cbb", "a\ua7dcb", "\U0003fa04\u0e20", "\u094d\U0003d66c", *fuzz]:
        assert c.count(x) == len(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_long_words_are_not_remembered():
    path = tokens.tokenizer_path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), tokens.Counter(path)
    long = "中文" * 20_000
    assert c.count(long) == len(t.encode(long, add_special_tokens=False).ids) and not c and not c.parts
    e = binary.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert e(["start " + long]) and not e.memo


def test_encoder_equals_the_library():
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), binary.Encoder(path)
    for _ in range(2):
        for x, got in zip(texts(), e(texts())):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_endings_are_no_words_of_their_own(monkeypatch):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    t, e, asked = Tokenizer.from_file(path), binary.Encoder(path), []
    ids_of = e.ids_of
    monkeypatch.setattr(e, "ids_of", lambda stems: asked.append(list(stems)) or ids_of(stems))
    some = ["so word. word, word! word (word) word\nword?\n", "so straße. straße, 中文! 中文 é; é½. ½. a\u3000 b\u3000", "so a<|endoftext|>. <b>. <| word.\x1c <b>, \n. \n\x85a. ...", "so", "so ", ""]
    for x, got in zip(some, e(some)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
    stems = [x for x in asked[0] if x]
    assert len(stems) == len(set(stems)) and {"word", "\nword", "straße", "中文"} <= set(stems)
    assert not {"word.", "word,", "word!", "\nword?", "straße.", "中文!"} & set(stems)


@pytest.mark.parametrize("n,symbols", [(0, 1), (1, 1), (5, 3), (1000, 1), (5000, 50257), (300_001, 70000), (600_000, 3)])
def test_segment_round_trip(n, symbols):
    ids = (np.random.default_rng(n).pareto(0.4, n) * 10).astype(np.int64) % symbols
    data = binary.encode_segment(ids)
    assert np.array_equal(binary.decode_segment(data), ids)
    if n > 1000:
        broken = bytearray(data)
        broken[len(broken) * 2 // 3] ^= 1
        with pytest.raises(ValueError):
            binary.decode_segment(bytes(broken))


def test_files(spark):
    rows = [(i * 5 % 97, x, "s", 0) for i, x in enumerate(texts(150))] + [(3, None, "s", 0), (None, "no id", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, data string, start int")
    t, at = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json")), 0
    want = []
    for d, x, _, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = sorted(map(tuple, binary.round_trip(df).collect()), key=lambda r: r[1])
    assert got == want
    assert binary.round_trip(df.limit(0)).collect() == []
    counts = tokens.count(df).collect()
    assert len(counts) == len(rows) and all(r.over_limit == (r.n_tokens > 2048) for r in counts)
    assert tokens.count(df.limit(0)).collect() == []


def test_counts_on_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r.doc_id: r.n_tokens for r in tokens.count(docs).collect()}
    t = Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))
    assert got == {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.select("doc_id", "text").collect()}
