from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np

from folioflow.llm import html_extract as h
from folioflow.llm.html_classifier import fitted, pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<div class="cookie-notice">We use cookies to improve your experience on this site and for a great many other reasons which we list at length.</div>
<header><a href="/">Home</a> <p>The site of all things</p></header><nav><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul></nav>
<div class="post"><h1>A title &amp; more</h1><div class="ad">Buy one and get another one for free, only today and only here, in our shop.</div>
<p>First   paragraph with <a href=x>a link</a> and enough words to look like prose, indeed.<br>After a break.</p><p>Yes.</p>
<ul><li>one item in the list<li>two items in the list</ul><pre>code  here
 x</pre><blockquote>A quote from someone &#8212; wise &lt;b&gt;.</blockquote>
<div id="comments"><h2>Comments</h2><div class="comment"><p>I liked this article a lot, it has taught me many things and I will come back to read it again and again, thank you.</p></div></div></div>
<aside><p>Another long sentence about something that is not part of the article at all, honest.</p></aside>
<form><p>Sign up for our letter today and get all of the news first.</p><textarea>text</textarea></form>
<div style="display: none">Hidden text of some length that nobody is ever going to see.</div><footer><p>&copy; 2020 Some company with a long name and an address line in the footer.</p></footer></body></html>"""


def test_the_article_and_nothing_else():
    assert h.main_text(PAGE).split("\n\n") == [
        "A title & more",
        "First paragraph with a link and enough words to look like prose, indeed. After a break.",
        "Yes.",
        "one item in the list",
        "two items in the list",
        "code here x",
        "A quote from someone — wise <b>.",
    ]


def test_odd_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<script>x</script>") == h.main_text("<!-- <p>a b c d e f g</p>") == ""
    assert h.main_text("<p>Just one paragraph of a text that is short.") == "Just one paragraph of a text that is short."
    assert h.main_text("<article><p>a < b and c &amp; d &nbsp; e</article>") == "a < b and c & d e"
    assert h.main_text("<article><p>one two three four five six<p>seven eight nine ten eleven</article>").count("\n\n") == 1


def test_pages_in_other_styles():
    """Pages that no generator made: wrappers, names that mislead, adverts and comments inside the article."""
    prose = "The ferry left the harbour before noon, and nobody on the pier had expected it to come back."
    more = "Its captain had been told that the wind would turn, so the whole crew stayed below and waited."
    cases = {
        f'<article><div class="social-history"><p>{prose}</p></div><p id="more">{more}</p></article>': [prose, more],
        "<p>ok</p>": ["ok"],
        f'<div id=wrapper><div class="row"><h1>Title</h1><p>{prose}</p><div class="ad-slot"><p>{more}</p></div><p>{more}</p></div><div class="right-sidebar"><p>{prose}</p></div></div>': ["Title", prose, more],
        f'<main><h1>Title</h1><p>{prose}</p><p>Yes.</p><p>{more}</p><section id="comments"><article class="comment"><p>{more}</p></article></section></main>': ["Title", prose, "Yes.", more],
        f'<div class="cookie-banner"><p>{more}</p></div><div class="story"><h2>Part one</h2><p>{prose}</p></div><footer><p>{more}</p></footer>': ["Part one", prose],
        f'<div class="masthead"><p>{more}</p></div><ul class="menu"><li><a href=a>Start</a></li><li><a href=b>End</a></li></ul><article class="post has-sidebar"><p>{prose}</p><ul><li>one thing</li><li>another thing</li></ul></article><form><p>{more}</p></form>': [prose, "one thing", "another thing"],
        f'<table><tr><td class="nav"><a href=a>Home</a></td><td><p>{prose}</p><p>{more}</p></td></tr></table>': [prose, more],
        f'<div role="navigation"><p><a href=x>{prose}</a></p></div><div role="main"><p>{more}</p></div><div role="alert">{prose}</div>': [more],
    }
    for page, want in cases.items():
        assert h.main_text(page).split("\n\n") == want, page


def accuracy(hard: bool, n: int = 300) -> tuple[float, float, int, int]:
    """Shares of blocks, and numbers of pages, that the cut and the classifier alone have right."""
    weights, same, cut, alone, whole, whole_alone = np.array(fitted(h.features)), 0, 0, 0, 0, 0
    for page in pages(n, 99, hard):
        found, x = h.features(page)
        odds, truth = x @ weights, np.array([b.text.startswith("C") for b in found])
        labels = np.array(h.label(found, odds))
        same, cut, alone = same + len(found), cut + (labels == truth).sum(), alone + ((odds > 0) == truth).sum()
        whole, whole_alone = whole + (labels == truth).all(), whole_alone + ((odds > 0) == truth).all()
    return cut / same, alone / same, whole, whole_alone


def test_the_classifier_and_the_cut_on_pages_it_has_not_seen():
    """Accuracy of blocks, and what the cut adds to the classifier alone."""
    cut, alone, whole, whole_alone = accuracy(hard=False)
    assert cut >= 0.985 and cut > alone
    assert whole >= whole_alone + 6


def test_pages_whose_names_tell_nothing():
    cut, alone, whole, whole_alone = accuracy(hard=True)
    assert cut >= 0.975 and cut > alone and whole > whole_alone


PROSE = "The ferry left the harbour before noon, and nobody on the pier had expected it to come back."
MORE = "Its captain had been told that the wind would turn, so the whole crew stayed below and waited."


def test_nothing_of_the_article_is_dropped_by_its_element():
    cases = {
        "The energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding=tex>E=m</annotation></math> as shown, they say.": "The energy is E=m as shown, they say.",
        "Press <button>Save</button> to keep the file as it is.": "Press Save to keep the file as it is.",
        "A drawing <object data=x>of a boat that</object> nobody has seen.": "A drawing of a boat that nobody has seen.",
        "A sign <svg viewBox=0><title>icon</title><text>EXIT</text></svg> over the door.": "A sign EXIT over the door.",
        "Written as <xmp>a &amp; <b></xmp> by hand.": "Written as a &amp; <b> by hand.",
    }
    for inner, want in cases.items():
        assert h.main_text(f"<article><h1>Title</h1><p>{PROSE}</p><p>{inner}</p></article>") == f"Title\n\n{PROSE}\n\n{want}", inner


def test_boilerplate_without_telling_names():
    body = f"<div class=x><h1>Title</h1><p>{PROSE}</p><p>{MORE}</p></div>"
    want = f"Title\n\n{PROSE}\n\n{MORE}"
    assert h.main_text(body + "<div class=y><h3>You may also like</h3><p><a href=1>Ten ships that sank</a></p><p><a href=2>A harbour in the north</a></p></div>") == want
    remark = f"<div class=c2><p>Anna 2 days ago</p><p>{MORE}</p><p><a href=#>Reply</a></p></div>"
    assert h.main_text(body + f"<div class=c1>{remark}{remark.replace('Anna 2', 'Bob 3')}</div>") == want
    assert h.main_text(f"<article><h1>Links</h1><ul><li><a href=1>A long story about ships</a></li><li><a href=2>How ferries work in winter</a></li><li><a href=3>The pier</a></li></ul></article>").count("\n\n") == 3
    assert h.main_text(f"<article><h1>Title</h1><p>{PROSE}</p><h2>Comments on the law</h2><p>{MORE}</p></article>").count("\n\n") == 3  # a heading of the article


def test_a_hidden_end_of_a_tag_is_its_own_affair():
    """After a tag whose end quotes hide, quotes count again."""
    page = f"<article><p>{PROSE}</p><p>{MORE} <a title=\"a > b\">link</a></p><p>{PROSE}</p></article><i x=\"><p>"
    assert h.main_text(page) == f"{PROSE}\n\n{MORE} link\n\n{PROSE}"


def test_stray_quotes_do_not_swallow_text():
    words, more = "one two three four five six seven", "eight nine ten eleven twelve"
    for tag in ("<a href=x title=it's>", '<a href=x title=5">', "<a it's>", "<a title='it>", '<a href=x="y>', '<a title = "a > b" rel=\'c > "d\'>', "<a href=x/y title=''>", "<a =\">", "<a title=\"a > b\">"):
        assert h.main_text(f"<article><p>{words} {tag}link</a> {more}</p></article>") == f"{words} link {more}", tag
    both = f"<article><p>{words} <a title=it's>link</a> {more}</p><p>{words} isn't <b>{more}</b></p></article>"
    assert h.main_text(both) == f"{words} link {more}\n\n{words} isn't {more}"
    assert h.main_text(f'<article><p>{words}</p><p class="a>b" {more}') == f"{words}\n\nb\" {more}"
    begun = time.time()
    for page in ('<a b=">" ' * 50_000, "<a b='>' " * 50_000 + '"', "<a b=" + " " * 500_000, "<a " + "b  " * 100_000):
        h.main_text(page)
    assert time.time() - begun < 30


def test_time_is_linear_in_bad_markup():
    begun = time.time()
    for page in ("<div>" * 100_000 + "<p>x y z", "<p>a b c d e f g" * 50_000, "<p " + 'a="' * 50_000, "<" * 100_000, "</p>" * 100_000, "<p a='" + "x" * 500_000):
        h.main_text(page)
    assert time.time() - begun < 30


def test_time_is_linear_in_open_elements():
    """Pages of 100,000 tags whose end tags end nothing, or whose elements are never ended."""
    for one in ("<div>x</section>", "<b><div>x</div>", "<i><hr>x", "<center>x", "<p><b><div>x", "<ul><li>x", "<a b='>", "<td></b>x", "<h2><i>x"):
        page = one * (100_000 // one.count("<"))
        begun = time.perf_counter()
        h.main_text(page)
        assert time.perf_counter() - begun < 15, one  # a walk up to the root for each takes minutes


def test_the_cut_is_minimal():
    rng = random.Random(14)
    for _ in range(200):
        n = rng.randint(1, 8)
        source, sink = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(a, b, float(rng.randint(0, 5))) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda on: sum(sink[i] if x else source[i] for i, x in enumerate(on)) + sum(w for a, b, w in edges if on[a] != on[b])  # noqa: B023, E731
        assert cost(h.minimum_cut(list(map(float, source)), list(map(float, sink)), edges)) == min(map(cost, itertools.product((True, False), repeat=n)))


def test_the_operator(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "y"), (3, "v", "", None), (1, "u", PAGE, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = h.extract(df).collect()
    assert sorted((str(r["page_id"]), r["n_chars"] == len(r["text"])) for r in got) == [("1", True), ("1", True), ("3", True), ("None", True)]
    assert h.extract(df.limit(0)).count() == 0


def test_large_ids_beside_null_ids(spark):
    df = spark.createDataFrame([(2**53 + 1, "u", PAGE), (None, "v", PAGE)], "page_id long, url string, html string").coalesce(1)
    assert {r["page_id"] for r in h.extract(df).collect()} == {2**53 + 1, None}


def test_stored_pages_give_their_articles(spark, sf_dir):
    def article(page: str) -> str:
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = (re.sub(r"\s+", " ", h.html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        return "\n\n".join(p for p in parts if p)

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in h.extract(pages).collect()} == want
