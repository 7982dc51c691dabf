"""Token counts by heap-and-linked-list byte-pair merging, and the tokenizer library behind a memo of words."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 2048
MEMO = 700_000  # words, and parts of words, remembered by a task; then it starts afresh
LONG = 64  # characters of a word that is remembered: about 100 bytes for each

# Fixed value: the split pattern of the word-end vocabulary, as its file has it, for ASCII.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-Z]+|[0-9]|[^\t-\r a-zA-Z0-9]+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Counter(dict):
    """space-free word -> number of tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["model"]["merges"])}
        self.end = model["model"].get("end_of_word_suffix") or ""
        special = [t["content"] for t in model["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.signs = {s[0] for s in special}
        white = {*range(9, 14), 32}
        self.signs_of_control = {b: c for b, c in enumerate(byte_letters()[:128]) if b not in white}
        self.parts: dict[str, int] = {}

    def merged(self, symbols: list[str]) -> int:
        """Symbols left when the adjacent pair of lowest rank, leftmost of equals, is merged again and again."""
        ranks, n = self.ranks, len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get(pair)) is not None]
        heapify(heap)
        left = n
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] is None or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            left -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heappush(heap, (r, h))
        return left

    def pieces(self, word: str) -> list[str]:
        """The word's parts, in the letters of their bytes. Beyond ASCII the library lower-cases, composes and
        splits, by its own Unicode tables; it gives byte letters itself."""
        if word.isascii():
            return PIECES.findall(word.lower().translate(self.signs_of_control))
        return [part for part, _ in self.split(self.normal(word)) if part]

    def symbols_left(self, piece: str) -> int:
        n = self.parts.get(piece)
        if n is None:
            symbols = list(piece)
            symbols[-1] += self.end
            n = self.merged(symbols)
            if len(piece) <= LONG:
                if len(self.parts) >= MEMO:
                    self.parts.clear()
                self.parts[piece] = n
        return n

    def __missing__(self, word: str) -> int:
        n = sum(map(self.symbols_left, self.pieces(word)))
        if len(word) <= LONG:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n

    def count(self, text: str) -> int:
        n = 0
        if self.special and any(s in text for s in self.signs):
            text, n = self.special.subn(" ", text)
        return n + sum(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(1)
def counter(path: str) -> Counter:
    return Counter(path)


def count(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_tokens long, over_limit boolean) per row.

    A null text counts as empty, with no tokens. Each row is counted alone: repeated rows get equal
    answers, an empty table none. A very long text is counted whole, word by word; a long word is merged
    but not remembered. Other columns aren't looked at. tokenizer: the vocabulary file's name.
    """

    def run(batches):
        c = counter(tokenizer_path(tokenizer))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [c.count(t) for t in texts]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
