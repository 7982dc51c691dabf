import itertools
import random
import re
import time
from html import unescape

import numpy as np
import pytest

from roadweave.llm import pages
from roadweave.session import table

PAGE = """<!doctype html><html><head><title>Never &amp; shown</title><style>p{}</style><script>var x="</p><p>no</p>";</script></head>
<body class="post"><header id="masthead"><h1>Site name</h1><nav><ul><li><a href="/">Home</a><li><a href=/b>About us</a></ul></nav></header>
<div class="cookie-notice">We use cookies to make the site better for everyone. Please accept.</div>
<main><article><header><h1>A head&shy;line &lt;here&gt;</h1></header><p>First&nbsp;paragraph of the
 article, with <a href=x>a link</a> &amp; more words.<p>Second one<br>over two lines.
<ul><li>An item of the article<li>Another item of it</ul><div class="advert">Buy this now! It is very cheap, today only, for everybody.</div>
<blockquote>Quoted words, said by somebody once.</blockquote><noscript>no</noscript><!-- hidden --></article>
<form><p>Your name please <input><button>Send</button></form></main>
<aside class="sidebar"><p>Other stories that have nothing to do with this one at all.</p></aside>
<section id="comments"><h2>3 comments</h2><article class="comment"><p>I read this and I liked it very much, thank you.</p></article></section>
<footer>&copy; somebody &middot; all rights reserved.</footer></body></html>"""


def test_page():
    assert pages.main_text(PAGE).split("\n") == [
        "A head\xadline <here>",
        "First paragraph of the article, with a link & more words.",
        "Second one over two lines.",
        "An item of the article",
        "Another item of it",
        "Quoted words, said by somebody once.",
    ]


PARAGRAPHS = "".join(f"<p>Paragraph {i} of the text says something at length, with many plain words in it.</p>" for i in range(6))
PLAIN = "\n".join(f"Paragraph {i} of the text says something at length, with many plain words in it." for i in range(6))


@pytest.mark.parametrize("names", ["content", "content no-sidebar", "main-content has-sidebar", "entry-content comments-open", "post tag-python", "article-body header-fixed", "post-content share-enabled", "sidebar", "page sidebar-layout"])
@pytest.mark.parametrize("shape", ["<div class='{}'><h1>A heading</h1>{}</div>", "<article><h1>A heading</h1><div class='{}'>{}</div></article>"])
def test_names_of_wrappers(names, shape):
    if "article" in shape and names == "sidebar":
        return  # a part of the article
    assert pages.main_text(f"<body><nav><a href=x>Home</a></nav>{shape.format(names, PARAGRAPHS)}<footer>All rights</footer></body>") == "A heading\n" + PLAIN


@pytest.mark.parametrize("names", ["sidebar", "site-footer", "comments-area", "cookie-notice", "nav-menu", "ad", "advert banner", "mainNav", "related-posts-list", "share-buttons"])
def test_names_of_other_parts(names):
    extra = f"<div class='{names}'><p>Some other words that don't belong to it at all, said in a sentence.</p></div>"
    assert pages.main_text(f"<div class=page><h1>A heading</h1>{PARAGRAPHS}</div>{extra}") == "A heading\n" + PLAIN


def test_controls_and_formulas_in_articles():
    text = pages.main_text(f"<article><p>The area is <math><mi>a</mi><mo>b</mo></math> and no more than that, as is known.</p><select><option>one{PARAGRAPHS}</article>")
    assert text.startswith("The area is ab and no more than that, as is known.\nParagraph 0") and text.endswith(PLAIN[-40:])
    assert pages.main_text(f"<form id=aspnetForm><div><h1>A heading</h1>{PARAGRAPHS}</div></form>") == "A heading\n" + PLAIN


def test_nested_and_wide_pages_take_time_in_proportion():
    def seconds(html):
        t = time.process_time()
        pages.main_text(html)
        return time.process_time() - t

    for one in (lambda n: "<div>" * n + PARAGRAPHS, lambda n: "<span>" * n + "x", lambda n: "<p>word word word.</p>" * n, lambda n: "<b> " * n, lambda n: "<li>a<ul>" * n):
        seconds(one(500))
        assert seconds(one(16_000)) < 20 * seconds(one(2_000)) + 0.5


def test_fitted_weights(spark):
    df = table(spark, "/root/testdata/sf0.01", "pages")
    w = pages.fit(df)
    assert w[pages.PLACE["links"]] < -5 and abs(w - pages.start())[pages.PLACE["p"] :].max() < 0.6 and pages.main_text(PAGE, w) == pages.main_text(PAGE)
    assert (pages.fit(df.limit(0)) == pages.start()).all()
    rng = np.random.default_rng(1)
    x, y = rng.random((80, len(pages.START))), rng.random(80) < 0.5
    loss = lambda v: np.logaddexp(0, -np.where(y, 1, -1) * (x @ v)).sum() + ((v - pages.start()) ** 2 / pages.NEAR).sum() / 2
    best = loss(v := pages.learn(x, y))
    assert all(loss(v + 1e-3 * d) >= best for d in rng.normal(size=(300, len(v))))


@pytest.fixture(scope="module")
def fitted(spark):
    return pages.fit(table(spark, "/root/testdata/sf0.1", "pages"))


SENTENCES = "".join(f"<div>Sentence {i} of a page of divs says something at some length, as the others do.</div>" for i in range(6))
SAID = "\n".join(f"Sentence {i} of a page of divs says something at some length, as the others do." for i in range(6))
KEPT = {
    "<html><head><title>x</title><body><article>" + PARAGRAPHS + "</article>": PLAIN,
    "<html><head><title>x</title><meta charset=utf-8><article><h1>A heading</h1>" + PARAGRAPHS + "</article>": "A heading\n" + PLAIN,
    "<title>x</title><h1>A heading</h1>" + PARAGRAPHS: "A heading\n" + PLAIN,
    "<head>Some text that isn't a title begins the body of the page here." + PARAGRAPHS: "Some text that isn't a title begins the body of the page here.\n" + PLAIN,
    "<article><h1>A heading</h1><noscript>" + PARAGRAPHS + "</article>": "A heading\n" + PLAIN,
    "<article><h1>A heading</h1><iframe src=x>" + PARAGRAPHS + "</article>": "A heading\n" + PLAIN,
    "<article><h1>A heading</h1><video src=x>" + PARAGRAPHS + "</article>": "A heading\n" + PLAIN,
    "<article><h1>A heading</h1><noscript><p>Please turn scripts on to see this page.</p></noscript>" + PARAGRAPHS + "</article>": "A heading\n" + PLAIN,
    "<div class=content><h1>A heading</h1>" + SENTENCES + "</div>": "A heading\n" + SAID,
    "<div><h1>A heading</h1>" + SENTENCES + "</div><footer>All rights</footer>": "A heading\n" + SAID,
    "<div><h1>A heading</h1>" + PARAGRAPHS + "<ul>" + "".join(f"<li>Item {i} of the list" for i in range(6)) + "</ul></div>": "A heading\n" + PLAIN + "\n" + "\n".join(f"Item {i} of the list" for i in range(6)),
    "<div>" + PARAGRAPHS + "<ol>" + "".join(f"<li>Item {i}" for i in range(6)) + "</ol>" + SENTENCES + "</div>": PLAIN + "\n" + "\n".join(f"Item {i}" for i in range(6)) + "\n" + SAID,
    "<div>" + PARAGRAPHS + "<table><tr><td>Alpha</td><td>12</td></tr><tr><td>Beta</td><td>13</td></tr></table></div>": PLAIN + "\nAlpha\n12\nBeta\n13",
    "<article>" + PARAGRAPHS + "<ul><li><a href=a>A first reference</a></li><li><a href=b>A second reference</a></li></ul></article>": PLAIN + "\nA first reference\nA second reference",
    "<article><h1>A heading</h1><section class='social'>" + PARAGRAPHS + "</section></article>": "A heading\n" + PLAIN,
    "<article>" + PARAGRAPHS + "</article><ol class='commentlist'><li><p>I read this and liked it very much, thank you all.</p></ol>": PLAIN,
    "<article>" + PARAGRAPHS + "</article><div id='discussion'><p>I read this and liked it very much, thank you all.</p></div>": PLAIN,
    "<article>" + PARAGRAPHS + "</article><div class='voices'><p>I read this and liked it very much, thank you all.</p></div>": PLAIN,
    "<div class='alert alert-info'>The shop is closed this week, please come again later.</div><article>" + PARAGRAPHS + "</article>": PLAIN,
    "<h1>A heading</h1><article>" + PARAGRAPHS + "<article><p>I read this and liked it very much.</p></article></article>": "A heading\n" + PLAIN,
    "<nav><ul>" + "".join(f"<li><a href=/{i}>Menu {i}</a>" for i in range(5)) + "</ul></nav><div><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(5)) + "</ul>" + PARAGRAPHS + "</div>": PLAIN,
}


@pytest.mark.parametrize("html", KEPT)
def test_shapes_of_pages(html, fitted):
    """With the starting weights and with those fitted to the corpus."""
    assert pages.main_text(html) == KEPT[html]
    assert pages.main_text(html, fitted) == KEPT[html]


def test_minimum_cut_against_all_labellings():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randrange(1, 8)
        leans = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(x):
            return sum(abs(v) for v, s in zip(leans, x) if (v > 0) != s) + sum(c for a, b, c in edges if x[a] != x[b])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(pages.cut(leans, edges)) - best) < 1e-6


def test_synthetic_pages(spark):
    df = table(spark, "/root/testdata/sf0.01", "pages")
    html = {r.page_id: r.html for r in df.collect()}
    for r in pages.extract(df, pages.fit(df)).collect():
        inner = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        want = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<<<>&#x;&bogus; </p></div>", "x"), (4, None, "<p>" * 3000 + "Deep text, with words enough to be kept as an article.", "x"), (1, None, None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.extract(df).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id in (1, 2)] == ["", "", ""]
    assert pages.extract(df.limit(0)).collect() == []
