"""Secret scans by grammar inference: probabilistic automata over credential formats.

Base findings are three fixed patterns. From labelled credentials of each kind a
prefix tree of character classes with counts is built, and its states are merged
where their next-symbol frequencies are compatible by the Hoeffding bound (red and
blue states, merges folded down the tree). The outcome is a probabilistic
automaton for each kind. Labels come from two places: the corpus, where the values
of base findings are credentials of their kind and all other candidates ordinary
words, in samples of bounded size; and a list of public token formats, of which
the corpus may hold none. Every candidate of a text is scored by its best
log-likelihood per character against a background of ordinary words; candidates
above the margin that no base finding covers are findings of kind "format". The
margin is the score that all but FALSE of the ordinary words stay below.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.session import cut

# The three base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KEYWORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ of 24 or more: runs are taken whole either way
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
KINDS = ("assign", "access", "hex", "format")
ALPHA, MARGIN, END = 0.05, 0.3, "$"
FALSE = 0.002  # share of ordinary candidates that may lie above the margin
LABELS, PLAIN = 200, 2000  # credentials of each kind, and ordinary words, that are learned from


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind as listed."""
    found = []
    if KEYWORDS.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in LONG_HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))]


def symbol(c: str) -> str:
    """Character class: digit, hexadecimal or other lower letter, capital, or the sign itself."""
    if "0" <= c <= "9":
        return "d"
    if "a" <= c <= "z":
        return "h" if c <= "f" else "l"
    return "C" if "A" <= c <= "Z" else c


class Automaton:
    """States with counts of arcs; END counts strings that stop."""

    def __init__(self, words: list[str]):
        self.count: list[dict] = [defaultdict(int)]
        self.to: list[dict] = [{}]
        for w in words:
            at = 0
            for s in w:
                self.count[at][s] += 1
                if s not in self.to[at]:
                    self.to[at][s] = len(self.to)
                    self.to.append({})
                    self.count.append(defaultdict(int))
                at = self.to[at][s]
            self.count[at][END] += 1

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            m, n = sum(self.count[a].values()), sum(self.count[b].values())
            bound = math.sqrt(math.log(2 / alpha) / 2) * (1 / math.sqrt(m) + 1 / math.sqrt(n)) if m and n else 1
            for s in {*self.count[a], *self.count[b]}:
                if abs(self.count[a].get(s, 0) / max(m, 1) - self.count[b].get(s, 0) / max(n, 1)) > bound:
                    return False
            todo += [(self.to[a][s], self.to[b][s]) for s in self.to[b] if s in self.to[a]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds the tree at b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for s, n in self.count[b].items():
                self.count[a][s] += n
            for s, c in self.to[b].items():
                if s in self.to[a]:
                    todo.append((self.to[a][s], c))
                else:
                    self.to[a][s] = c

    def merged(self, alpha: float = ALPHA) -> Automaton:
        """Red states stay; a blue state, next to them, joins a compatible red one or turns red."""
        red, inside = [0], {0}
        while blue := min(((r, s, c) for r in red for s, c in self.to[r].items() if c not in inside), default=None):
            r, s, c = blue
            for other in red:
                if self.compatible(other, c, alpha):
                    self.to[r][s] = other
                    self.fold(other, c)
                    break
            else:
                red.append(c)
                inside.add(c)
        return self

    def table(self) -> list[dict]:
        """Per state, symbol -> (log probability, next state), with room for unseen symbols."""
        out = []
        for count, to in zip(self.count, self.to):
            total = sum(count.values()) + 0.5
            out.append({s: (math.log(n / total), to.get(s, 0)) for s, n in count.items()} | {"": (math.log(0.5 / total / 70), 0)})
        return out


# Public formats of tokens, as prefix, letters (u: capitals, l: small, d: digits, others as they are) and length.
FORMATS = """ghp_ uld 36, gho_ uld 36, ghs_ uld 36, github_pat_ uld_ 82, glpat- uld_- 20, sk_live_ uld 24, pk_live_ uld 24, rk_live_ uld 24,
xoxb- d 12 - d 12 - uld 24, xoxp- d 12 - d 12 - d 12 - ld 32, AIza uld_- 35, npm_ uld 36, pypi- uld_- 150, SG. uld_- 22 . uld_- 43, SK ld 32, shpat_ ld 32,
AKIA ud 16, ASIA ud 16, ya29. uld_- 60, eyJ uld 33 . eyJ uld 40 . uld_- 43, dop_v1_ ld 64, hf_ ul 34"""
LETTERS = {"u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "l": "abcdefghijklmnopqrstuvwxyz", "d": "0123456789"}


def shaped(rng: random.Random, shape: list[str]) -> str:
    """A random token of a format: literal parts, and letters followed by a number of them."""
    out, i = "", 0
    while i < len(shape):
        if i + 1 < len(shape) and shape[i + 1].isdigit():
            letters = "".join(LETTERS.get(c, c) for c in shape[i])
            out += "".join(rng.choice(letters) for _ in range(int(shape[i + 1])))
            i += 2
        else:
            out += shape[i]
            i += 1
    return out


def known_formats(seed: int = 11, each: int = 60) -> dict[str, list[str]]:
    """Tokens of the public formats, and ordinary words of the kinds that texts may hold, under ""."""
    rng = random.Random(seed)
    shapes = [f.split() for f in FORMATS.replace("\n", " ").split(",")]
    found = {" ".join(f): [shaped(rng, f) for _ in range(each)] for f in shapes}
    found["mixed"] = [shaped(rng, ["uld+/", str(rng.choice((32, 40, 44)))]) for _ in range(4 * each)]
    syllables = ("the", "an", "er", "on", "in", "ti", "ou", "re", "st", "ed", "la", "que", "ver", "cion", "ment", "sch")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(5, 12)))
    uuid = lambda: "-".join("".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))
    path = lambda: f"{word()}/{word()}-{rng.randrange(2000, 2030)}/{word()}.html"
    plain = (word, lambda: word().title(), lambda: word().upper(), lambda: f"{word()}-{word()}", lambda: f"www.{word()}.com/{word()}", path, lambda: f"{word()}_{rng.randrange(10000)}", lambda: "-" * rng.randrange(16, 60), lambda: f"{rng.randrange(10**17, 10**18)}", uuid, lambda: f"2024-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}.00.00Z")
    found[""] = [f() for f in plain for _ in range(2 * each)]
    return found


def candidates(text: str):
    """(start, end, word) of what may be a credential: 16 or more of its letters in a row."""
    for m in CANDIDATE.finditer(text):
        w = m[0].strip(".=-")
        if len(w) >= 16:
            a = m.start() + m[0].index(w)
            yield a, a + len(w), w


def labels_of(text: str):
    """(kind, word): values of base findings of 16 or more characters, and the other candidates under ""."""
    base = base_spans(text)
    for a, b, kind in base:
        value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
        if len(value) >= 16:
            yield kind, value
    for a, b, w in candidates(text):
        if not any(x < b and a < y for x, y, _ in base):
            yield "", w


class Grammar:
    """Automata of the kinds, a background of ordinary words, and the margin between them."""

    def __init__(self, samples: dict[str, list[str]]):
        self.tables = [Automaton(["".join(map(symbol, w)) for w in words]).merged().table() for k, words in samples.items() if k and words]
        pairs = defaultdict(lambda: defaultdict(int))
        for w in samples.get("", ()):
            for a, b in zip(" " + w, w + " "):
                pairs[a.lower()][b.lower()] += 1
        self.pairs = {a: {b: math.log(n / (sum(to.values()) + 8)) for b, n in to.items()} for a, to in pairs.items()}
        plain = sorted(map(self.likelihood, samples.get("", ())))
        self.margin = max([MARGIN, *plain[int(len(plain) * (1 - FALSE)) :][:1]])

    def likelihood(self, word: str) -> float:
        """Best log-likelihood ratio per character of the automata against ordinary words."""
        symbols = "".join(map(symbol, word))
        best = max((_log_likelihood(t, symbols) for t in self.tables), default=-math.inf) - sum(map(_size, symbols))
        low, none = word.lower(), -math.log(300)
        plain = sum(self.pairs.get(a, {}).get(b, none) for a, b in zip(" " + low, low + " "))
        return (best - plain) / (len(word) + 1)

    def is_secret(self, word: str) -> bool:
        return self.likelihood(word) > self.margin


def _log_likelihood(table: list[dict], symbols: str) -> float:
    at, total = 0, 0.0
    for s in symbols + END:
        step = table[at].get(s) or table[at][""]
        total += step[0]
        at = step[1]
    return total


# Log number of characters in a class: a class-level model spreads evenly over them.
SIZES = {"d": math.log(10), "h": math.log(6), "l": math.log(20), "C": math.log(26)}


def _size(s: str) -> float:
    return SIZES.get(s, 0.0)


def labelled(docs: DataFrame, labels: int = LABELS, plain: int = PLAIN) -> dict[str, list[str]]:
    """Credentials of each base kind and ordinary words in docs(text), the smallest by a hash: at most labels of each
    kind, and plain words."""

    most = {k: labels if k else plain for k in (*KINDS[:3], "")}

    def run(batches):
        # the smallest of this task, of each kind
        held = {k: set() for k in most}

        def cut_back():
            for k, found in held.items():
                held[k] = set(heapq.nsmallest(most[k], found))

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for k, w in labels_of(t or ""):
                    held[k].add((xxhash.xxh3_64_intdigest(w) >> 1, w))
                if any(len(found) > 2 * most[k] + 1000 for k, found in held.items()):
                    cut_back()
        cut_back()
        rows = [(k, h, w) for k, found in held.items() for h, w in found]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.string(), pa.int64(), pa.string()))], names=["kind", "h", "word"])

    each = cut(docs.select("text").mapInArrow(run, "kind string, h long, word string").distinct())
    return {k: [r.word for r in each.where(F.col("kind") == k).orderBy("h", "word").limit(n).collect()] for k, n in most.items()}


def fit(docs: DataFrame | None = None) -> Grammar:
    """The grammar of the public formats and of docs' own labels."""
    samples = known_formats()
    for kind, words in (labelled(docs) if docs is not None else {}).items():
        samples[kind] = samples.get(kind, []) + words
    return Grammar(samples)


def scan(text: str, is_secret) -> tuple[list, list]:
    """(base spans, all spans). An empty text has none."""
    base = base_spans(text)
    spans = list(base)
    ends = [0]
    for _, b, _ in base:
        ends.append(max(ends[-1], b))
    begins = [a for a, _, _ in base]
    for a, b, w in candidates(text):
        # base findings that begin before b, the furthest end of which lies beyond a, overlap
        if ends[bisect_left(begins, b)] <= a and is_secret(w):
            spans.append((a, b, "format"))
    return base, sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, grammar: Grammar | None = None) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, base string, spans string, n_assign, n_access, n_hex long) per row.

    Spans are kind:start:end, joined by commas; a null or empty text has none. Each row is scanned
    alone and whole, however long: repeated rows get equal answers, an empty table none. Other columns
    aren't looked at. grammar: of fit, else that of the public formats alone.
    """
    grammar = docs.sparkSession.sparkContext.broadcast(grammar or fit())

    def run(batches):
        is_secret = lru_cache(50_000)(grammar.value.is_secret)
        for batch in batches:
            out = [[] for _ in range(5)]
            for t in batch.column(1).to_pylist():
                base, spans = scan(t or "", is_secret)
                kinds = [k for _, _, k in base]
                for column, v in zip(out, (joined(base), joined(spans), *(kinds.count(k) for k in KINDS[:3]))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), *(pa.array(c, pa.int64()) for c in out[2:])], names=["doc_id", "base", "spans", "n_assign", "n_access", "n_hex"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, base string, spans string, n_assign long, n_access long, n_hex long")
