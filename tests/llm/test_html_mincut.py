import itertools
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from noteloom.llm.html_mincut import blocks_of, edges_of, extract_main_text, main_text, max_flow_side, min_cut

PAGE = """<!doctype html><html><head><title>Site | A title</title><style>p>a{x:1}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body class="single has-sidebar"><header class="site-header"><h1>The Site</h1><p>Words that greet every visitor of this site.</p></header>
<nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav>
<div id="cookie-notice"><p>We use cookies, and so does everyone. Please accept them all.</p></div>
<main><article class="post"><header><h1>A title &amp; more</h1></header>
<p>First   paragraph,<br>with a break &mdash; and <b>bold</b><i>italic</i> parts.
<p>Second one. <!-- <p>hidden</p> --><a href="x>y">A link</a> stays.
<div class="ad">Buy now, pay later. Offers that end today.</div>
<ul><li>Point one</li><li>Point two</li></ul>
<form><label>Mail</label><input name=q><button>Send</button></form>
<aside>Also of interest to some readers.</aside>
<p>Yes.</p><blockquote>A quote &#8220;with&#8221; signs &lt;b&gt;.</blockquote>
<footer>Filed under things.</footer></article>
<section id="comments"><article class="comment"><p>I liked this very much, thank you for writing it down.</p></article></section></main>
<div class="sidebar"><p>Some long text in a sidebar, which nobody reads to the end, ever.</p></div>
<footer>&copy; 2024 The Site</footer></body></html>"""
WANT = "A title & more\nFirst paragraph, with a break — and bolditalic parts.\nSecond one. A link stays.\nPoint one\nPoint two\nYes.\nA quote “with” signs <b>."

SOUP = """<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div>
<div><div><h2>Heading here</h2></div><div>A long text in a plain division, with several words and an end.</div>
<div>Short bit.</div><div>Another long text in a plain division, with several words and an end.</div></div>
<div><a href=3>Terms</a> | <a href=4>Contact</a></div><div>&copy; 2020 Someone</div></body>"""


def test_articles():
    assert main_text(PAGE) == WANT


def test_pages_without_landmarks():
    lines = main_text(SOUP).split("\n")
    assert "Short bit." in lines and len(lines) in (3, 4) and not any("Terms" in x or "One" in x or "©" in x for x in lines)


def test_odd_markup():
    assert main_text(None) == main_text("") == main_text("<p></p>") == ""
    assert main_text("<article><p>a < b and c &lt d &am</p><p>cut off <a href='x") == "a < b and c < d &am\ncut off"
    assert main_text("<article><p title='a>b'>text</p><script>var t='</p>'") == "text"
    assert main_text("<article>" + "<b><a <a" * 3) == ""
    assert len(blocks_of("<div>" * 3000 + "x")) == 1
    assert main_text("<article>" + "<p>word goes here.</p>" * 5000).count("\n") == 4999


def brute(score, edges):
    best = None
    cost = lambda labels: sum(math.log1p(math.exp(-s if x else s)) for s, x in zip(score, labels)) + sum(w for i, j, w in edges if labels[i] != labels[j])
    for labels in itertools.product([False, True], repeat=len(score)):
        c = cost(labels)
        best = c if best is None else min(best, c)
    return best, cost


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_cut_is_least(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    score = [rng.uniform(-3, 3) for _ in range(n)]
    edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
    best, cost = brute(score, edges)
    assert abs(cost(min_cut(score, edges)) - best) < 1e-6
    soft = [math.log1p(math.exp(-abs(x))) for x in score]
    side = max_flow_side([max(x, 0) + y for x, y in zip(score, soft)], [max(-x, 0) + y for x, y in zip(score, soft)], edges)
    assert abs(cost(side) - best) < 1e-6


def test_edges_join_neighbours():
    blocks = blocks_of("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    assert [(i, j) for i, j, _ in edges_of(blocks)] == [(0, 1), (1, 2)]


def test_table(spark):
    rows = [(1, "u", PAGE, "text"), (1, None, PAGE, None), (None, "v", None, "x"), (2, "w", "", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(str, ([*r] for r in extract_main_text(pages).collect())))
    assert got == sorted(map(str, [[1, "u", WANT, len(WANT)], [1, None, WANT, len(WANT)], [None, "v", "", 0], [2, "w", "", 0]]))
    assert extract_main_text(pages.limit(0)).collect() == []
