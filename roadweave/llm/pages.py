"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a tree of elements, and its texts become blocks: runs of text
without a block-level boundary. A linear classifier over a block's text and
surroundings gives it a cost of being boilerplate (source capacity) and a cost of
being content (sink capacity). Neighbouring blocks, and blocks of one parent, are
joined by smoothness edges that are paid when the two get different labels. The
minimum cut is found by augmenting paths; blocks on the source's side are content.

The classifier is a logistic regression fitted to the corpus: in a bounded sample
of pages the semantic elements (article and main, against nav, aside, footer,
header, form and the like) label blocks, and the weights of length, sentences and
links are learned from blocks with these elements hidden, near starting values
that stand where the sample says nothing. Weights of tags hardly move: which
of them an article is written with says more of the corpus than of its pages.

Where articles (or main) hold half of the page's words or more, what stands outside
them isn't content, whatever it is called, but for a main heading that they lack;
an article in an article is a comment on it. Elements that end by themselves in
HTML end here too: a head at the first thing that can't stand in it, and one that
hides its content but is never closed hides nothing.

Names (class, id, role) count word by word: "sidebar", "site-footer" or
"comments-area" speak against a part, "no-sidebar", "comments-open" or
"tag-python" are properties of the page and say nothing. What speaks against an
element with the page's main heading or <main> and half of its words is ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg canvas audio video head title button select textarea option datalist".split())
# Silent elements that hold no blocks: one that is left open ends where a block begins.
PHRASING = frozenset("button select option datalist svg canvas textarea".split())
WHOLE = ("article", "main")
# What may stand in a head; and silent elements that hide nothing where they are never closed.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
CLOSED = ("noscript", "iframe", "video", "audio", "template", "head")
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
ALIKE = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}

# Words of class, id and role names, by what they speak for.
AGAINST = frozenset("ad ads alert alerts advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright discussion discussions disqus disclaimer foot footer gdpr header login masthead menu modal nav navbar navigation notice notices notification newsletter pager pagination popup promo promotion related replies reply respond recommended recommendations share sharing side sidebar sidenav signup skip social sponsor sponsored subscribe subscription toc toolbar tooltip topbar widget widgets contentinfo complementary".split())
TOWARD = frozenset("article body content entry main post story text".split())
# Words beside these that leave their meaning as it is, and ones before them that turn it into a property.
FORM = frozenset("area articles bar block blocks bottom box button buttons col column container div global group holder icon icons inner item items left level link links list main menu outer page panel posts primary right row secondary section site slot stories text top unit wrap wrapper".split())
# Words that name topics as well: in an article they say nothing of a part with this many words that aren't links.
TOPICS, PROSE = frozenset("alert alerts banner discussion discussions header login notice notices promo promotion share sharing side social sponsor toolbar top widget widgets".split()), 25
PROPERTY = frozenset("has hide is no not show single toggle with without".split())
TITLES = frozenset("header head heading".split())

# The classifier's features with their starting weights; positive speaks for content.
START = {"bias": -0.4, "words": 3.0, "sentence": 0.6, "links": -5.0, "p": 1.5, "h1": 1.0, "h2": 0.8, "h3": 0.6, "h4": 0.4, "blockquote": 1.0, "pre": 1.0, "li": 0.5, "td": 0.5, "th": 0.5, "dd": 0.5, "dt": 0.5, "figcaption": 0.3, "div": 0.0}
PLACE = {k: i for i, k in enumerate(START)}
# Weights of the elements and names that blocks stand in.
INSIDE = {"article": 4.0, "main": 3.0, "nav": -9.0, "aside": -8.0, "footer": -8.0, "form": -8.0, "dialog": -8.0, "menu": -8.0, "search": -8.0, "fieldset": -6.0, "header": -6.0}
NAMED_AGAINST, NAMED_TOWARD, HIDDEN, HIGHEST, OUTSIDE, NESTED = -8.0, 1.5, -20.0, 6.0, -5.0, -6.0
NEXT, SIBLING = 1.0, 0.6
LINKS_INSIDE = 0.65  # links count so much less in an article or main
SAMPLE = 500  # pages that the weights are fitted on
NEAR = np.array([{"links": 0.25, "words": 0.02, "sentence": 0.005}.get(k, 0.001) for k in START])  # variance of a weight around its start


def parts(word: str) -> list[str]:
    """A word that is a name and a form written together ("commentlist") as the two."""
    if word not in AGAINST:
        for k in range(3, len(word) - 2):
            if word[:k] in AGAINST and word[k:] in FORM:
                return [word[:k], word[k:]]
    return [word]


def speaks(names: str) -> int:
    """-1 if a word among the names speaks against content, 1 if one speaks for it, else 0."""
    found = 0
    for name in names.split():
        words = [part for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name) for part in parts(w.lower())]
        if not words or words[0] in PROPERTY:
            continue
        if words[0] in TOWARD and words[-1] in TITLES:  # an article's own heading
            found = 1
            continue
        first, last = words[0] in AGAINST, words[-1] in AGAINST
        if last or first and all(w in FORM or w in AGAINST or w in TOWARD for w in words[1:]):
            return -1
        if words[0] in TOWARD and all(w in FORM or w in TOWARD for w in words[1:]) or words[-1] in TOWARD:
            found = 1
    return found


class Node:
    __slots__ = ("tag", "parent", "silent", "depth", "block", "in_article", "own", "hidden", "lean", "words", "chief", "topic", "within", "holds", "bad")

    def __init__(self, tag: str, parent: Node | None, attributes):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.silent = tag in SILENT or bool(parent and parent.silent)
        self.block = self if tag in BLOCKS or parent is None else parent.block
        self.in_article = bool(parent and (parent.in_article or parent.tag == "article"))
        self.words, self.chief, self.lean, self.topic = 0, tag in ("main", "h1"), 0.0, False
        self.within = bool(parent and (parent.within or parent.tag in WHOLE))
        self.holds = False
        values = dict(attributes)
        own = 0.0 if tag == "header" and self.in_article else INSIDE.get(tag, 0.0)
        if tag not in ("body", "html", "article", "main"):
            called = " ".join(values.get(k) or "" for k in ("class", "id", "role", "itemtype"))
            said = speaks(called)
            own += NAMED_AGAINST if said < 0 else NAMED_TOWARD if said > 0 else 0.0
            self.topic = said < 0 and self.in_article and tag not in INSIDE and speaks(" ".join(c for c in called.split() if c.lower() not in TOPICS)) >= 0
        self.own = own
        self.bad = own < -3 or bool(parent and parent.bad)
        self.hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in (values.get("style") or "").replace(" ", "")


class Block:
    __slots__ = ("text", "node", "linked", "chars")

    def __init__(self, text: str, node: Node, linked: int, chars: int):
        self.text, self.node, self.linked, self.chars = text, node, linked, chars


class Blocks(HTMLParser):
    """Collects the blocks of a page, leniently: unclosed and stray tags are put right as browsers do, roughly."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.ends = Counter(m.lower() for m in re.findall(rf"</({'|'.join(CLOSED)})(?=[\s/>])", html, re.I))  # end tags still to come
        self.at = Node("html", None, ())
        self.nodes = [self.at]  # parents before children
        self.open: dict[str, list[Node]] = {}
        self.found: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.owner: Node | None = None

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split(None)) if self.owner else ""
        if text:
            self.found.append(Block(text, self.owner, self.linked, max(1, sum(map(len, self.parts)))))
        self.parts, self.linked, self.owner = [], 0, None

    def open_above(self, tag: str, until: frozenset | set = frozenset()) -> Node | None:
        """The innermost open element of this tag, if none of the others is open inside it."""
        stack = self.open.get(tag)
        if not stack or any(self.open.get(u) and self.open[u][-1].depth > stack[-1].depth for u in until):
            return None
        return stack[-1]

    def close(self):
        super().close()
        self.end_block()

    def leave(self, node: Node) -> None:
        while True:
            last = self.at
            self.open[last.tag].pop()
            self.at = last.parent
            if last is node:
                break

    def end_head(self) -> None:
        if head := self.open_above("head"):
            self.leave(head)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED and tag != "head" and not self.ends[tag]:
            return
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCKS:
            self.end_block()
            if self.at.silent:
                for t in PHRASING:
                    if node := self.open_above(t):
                        self.leave(node)
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CLOSES_P and (p := self.open_above("p", {"td", "th", "button", "object"})):
            self.leave(p)
        if tag in ALIKE and (same := self.open_above(tag, set(ALIKE[tag].split()))):
            self.leave(same)
        self.at = Node(tag, self.at, attrs)
        self.nodes.append(self.at)
        self.open.setdefault(tag, []).append(self.at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "a", "span", "b", "i"):  # HTML ignores the slash elsewhere
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in CLOSED:
            self.ends[tag] -= 1
        if tag in BLOCKS:
            self.end_block()
        if node := self.open_above(tag):
            self.leave(node)

    def handle_data(self, data):
        if self.at.tag == "head" and not data.isspace():
            self.end_head()
        if self.at.silent or not data:
            return
        if self.owner is None and not data.isspace():
            self.owner = self.at.block
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += len(data)


def weigh(nodes: list[Node], found: list[Block]) -> None:
    """Sets each node's lean: what the elements and names above a block say."""
    whole = 0
    for b in found:
        n = (b.text.count(" ") + 1) * (2 * b.linked < b.chars)
        b.node.words += n
        whole += n
    for node in reversed(nodes):
        if node.parent:
            node.parent.words += node.words
            node.parent.chief |= node.chief
            node.parent.holds |= node.holds or node.tag in WHOLE
    articles = 2 * sum(n.words for n in nodes if n.tag in WHOLE and not n.within and not n.bad) >= max(whole, 1)
    headed = any(n.tag == "h1" and n.within and not n.bad for n in nodes)
    for node in nodes:
        own = node.own
        if node.topic and node.words >= PROSE:
            own = 0.0
        if node.tag == "article" and node.in_article and 2 * node.words < whole:
            own = NESTED
        if articles and node.block is node and not (node.holds or node.within or node.tag in WHOLE) and (headed or node.tag != "h1"):
            own = min(own, OUTSIDE)
        if own < 0 and node.chief and node.tag not in ("main", "h1") and 2 * node.words >= whole:
            own = 0.0
        if node.hidden:
            own += HIDDEN
        above = node.parent.lean if node.parent else 0.0
        # a part against stays against, whatever stands inside it
        node.lean = min(above, own) if min(above, own) < -3 else min(above + own, HIGHEST)


def features(block: Block) -> np.ndarray:
    """The block by itself: length, sentence, links and tag."""
    x = np.zeros(len(START))
    x[0] = 1
    x[PLACE["words"]] = min(block.text.count(" ") + 1, 25) / 25
    x[PLACE["sentence"]] = block.text[-1] in ".!?…:;"
    x[PLACE["links"]] = min(1.0, block.linked / block.chars) * (LINKS_INSIDE if block.node.lean >= INSIDE["main"] else 1.0)
    if block.node.tag in PLACE:
        x[PLACE[block.node.tag]] = 1
    return x


def start() -> np.ndarray:
    return np.array(list(START.values()))


def learn(x: np.ndarray, content: np.ndarray, near: float = NEAR) -> np.ndarray:
    """Weights of largest posterior probability: logistic regression, normal around the starting weights."""
    w = start()
    if not len(x):
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / near
        step = np.linalg.solve(h, x.T @ (p - content) + (w - start()) / near)
        w = w - np.clip(step, -1, 1)
    return w


def cut(leans: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for what is on the source's side of the minimum cut: augmenting shortest paths."""
    n = len(leans)
    source, sink = n, n + 1
    arcs: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, x in enumerate(leans):
        a, b = (source, i) if x > 0 else (i, sink)
        arcs[a][b], arcs[b][a] = abs(x), 0.0
    for i, j, c in edges:
        arcs[i][j] = arcs[i].get(j, 0.0) + c
        arcs[j][i] = arcs[j].get(i, 0.0) + c
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in arcs[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level for i in range(n)]
        tried = {u: iter(list(arcs[u])) for u in level}
        path = [source]
        while path:  # a blocking flow in the layered network
            u = path[-1]
            if u == sink:
                low = min(arcs[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    arcs[a][b] -= low
                    arcs[b][a] += low
                path = path[: next(k for k, (a, b) in enumerate(zip(path, path[1:])) if arcs[a][b] <= 1e-9) + 1]
                continue
            for v in tried[u]:
                if arcs[u][v] > 1e-9 and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level[u] = -1


def blocks(html: str) -> list[Block]:
    """The page's blocks, their nodes weighed."""
    parser = Blocks(html)
    parser.feed(html)
    parser.close()
    weigh(parser.nodes, parser.found)
    return parser.found


def label(found: list[Block], weights: np.ndarray) -> list[bool]:
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1].node
            steps = abs(a.depth - b.node.depth) + 1
            edges.append((i - 1, i, NEXT / steps))
        parent = id(b.node.parent)
        if parent in last:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    alone = (np.array([features(b) for b in found]) @ weights).tolist() if found else []
    return cut([b.node.lean + (x if b.node.lean > -3 else 0.0) for b, x in zip(found, alone)], edges)


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    """Content blocks in page order, joined by line breaks; '' if there are none."""
    if not html:
        return ""
    found = blocks(html)
    return "\n".join(b.text for b, keep in zip(found, label(found, start() if weights is None else weights)) if keep)


def fit(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most sample pages(page_id, html), those of smallest hash, in one task."""
    chosen = pages.where("html is not null").select("html").orderBy(F.xxhash64("html"), "html").limit(sample)

    def run(batches):
        x, y = [], []
        for batch in batches:
            for html in batch.column(0).to_pylist():
                for b in blocks(html):
                    if b.node.lean < -3 or b.node.lean >= INSIDE["main"]:
                        x.append(features(b))
                        y.append(b.node.lean > 0)
        w = learn(np.array(x).reshape(-1, len(START)), np.array(y, float))
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["w"])

    found = chosen.repartition(1).mapInArrow(run, "w array<double>").first()
    return np.array(found["w"]) if found else start()


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """pages(page_id, url, html) -> (page_id, url, text, n_chars long) per row; weights: of fit, else the starting ones.

    Null and empty html give ''; repeated rows get equal answers; an empty table gives an empty table. Very long and
    deeply nested pages are read whole, in time that grows with their size. Other columns aren't looked at.
    """
    weights = start() if weights is None else weights

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pc.cast(pc.utf8_length(pa.array(texts, pa.string())), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
