"""What the cut decides, and extraction against a plain reader of generated pages."""

import random
import time
from html.parser import HTMLParser
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from noteloom.llm.html_mincut import blocks_of, edges_of, labels_of, main_text

PAGES = Path("/root/testdata/sf0.1/pages.parquet")


def test_the_cut_overrules_a_block():
    """A short line is boilerplate by its own score, and content by what stands around it; the same line in a menu goes."""
    long = "<p>This paragraph has a good number of words, as paragraphs of articles do.</p>"
    page = f"<body><article>{long}<p><a href=/x>Or so</a></p>{long}<ul><li>and on</li></ul>{long}</article><div class=menu><p><a href=/x>Or so</a></p><ul><li>and on</li></ul></div></body>"
    blocks = blocks_of(page)
    score, kept = labels_of(blocks)
    assert [b.text for b, s, k in zip(blocks, score, kept) if k and s < 0] == ["Or so", "and on"]
    assert kept == [True] * 5 + [False] * 2


def test_doubtful_words_are_only_evidence():
    around = "<p>First paragraph of some length is here.</p>{}<p>Last paragraph of some length is here.</p>"
    for page in ("<article>" + around + "</article>", "<body><div>" + around + "</div></body>"):
        for line in ('<p class="related-work">Work that others did on this.</p>', "<p id=discussion>What follows from all of that is this.</p>"):
            assert main_text(page.format(line)).count("\n") == 2, line
    assert "rose by" in main_text("<article>" + around.format('<div class="share-price"><p>The price rose by a tenth in one day.</p></div>') + "</article>")
    for clutter in ('<div class="share-buttons"><p>Share this with your friends.</p></div>', '<div class="ad"><p>Buy this, it is really very good.</p></div>', '<p class="advert">Buy this, it is really very good.</p>', '<aside class="x"><p>See what else there is to be seen.</p></aside>'):
        assert main_text("<article>" + around.format(clutter) + "</article>").count("\n") == 1, clutter


def test_scripts_and_styles_never_show():
    assert main_text("<article><script src=/js/>var leak=1;</script><p>Real text is here.</p>") == "Real text is here."
    assert main_text("<article><style media=x/>p{color:red}</style><p>Real text is here.</p>") == "Real text is here."
    assert main_text("<article><p>Real text <svg viewbox=x/> is here.</p>") == "Real text is here."


@pytest.mark.parametrize("page", ["<div>x" * 200_000, "<b><div>" + "<i>y" * 150_000 + "</b>" * 150_000, "<div>" * 100_000 + "</section></p>" * 70_000 + "x", "<ul><li><a>z" * 90_000])
def test_deep_pages_take_time_in_proportion(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 15


class Plain(HTMLParser):
    """Text of an article by block, all of what is in a dropped element left out."""

    BLOCK = {"p", "div", "li", "ul", "h1", "h2", "article", "section", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.now, self.out = [], "", []

    def flush(self):
        text = " ".join(self.now.split())
        if text and "article" in [t for t, _ in self.open] and not any(gone for _, gone in self.open):
            self.out.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now += " "
            return
        if tag in self.BLOCK or tag in ("nav", "aside", "form", "footer", "header"):
            self.flush()
        inside = "article" in [t for t, _ in self.open]
        gone = tag in ("nav", "aside", "form", "footer", "script", "style") or (tag == "header" and not inside) or dict(attrs).get("class") in ("ad", "comments", "sidebar", "cookie-notice")
        self.open.append((tag, gone))

    def handle_endtag(self, tag):
        if tag in self.BLOCK or tag in ("nav", "aside", "form", "footer", "header"):
            self.flush()
        self.open.pop()

    def handle_data(self, data):
        if not self.open or self.open[-1][0] not in ("script", "style"):
            self.now += data


def made_page(rng):
    words = lambda a, b: " ".join(rng.choices("some plain words that stand in a row &amp; more caf&eacute; of them".split(), k=rng.randint(a, b)))
    sentence = lambda: words(4, 40).capitalize() + rng.choice([".", "!", "?"])
    clutter = [
        lambda: f"<nav><ul><li><a href=/>{words(1, 2)}</a></li><li><a href=/x>{words(1, 3)}</a></li></ul></nav>",
        lambda: f"<div class='ad'><p>{sentence()}</p></div>",
        lambda: f"<aside><p>{sentence()}</p><p>{sentence()}</p></aside>",
        lambda: f"<div class='sidebar'><p>{sentence()}</p></div>",
        lambda: f"<div class='comments'><p>{sentence()}</p><p>{words(1, 3)}</p></div>",
        lambda: f"<div class='cookie-notice'><p>{sentence()}</p></div>",
        lambda: f"<form><p>{words(1, 4)}</p></form>",
        lambda: "<script>if (a < b) x('</p>');</script>",
        lambda: "<style>p > a { b: c }</style>",
    ]
    content = [
        lambda: f"<p>{sentence()}<br>{sentence()}</p>",
        lambda: f"<p>{words(1, 3)}</p>",
        lambda: f"<p>See <a href='/q?a>b'>{words(1, 2)}</a> <b>{words(1, 3)}</b>{sentence()}</p>",
        lambda: f"<ul><li>{words(2, 9)}</li><li>{sentence()}</li></ul>",
        lambda: f"<blockquote>{sentence()}</blockquote>",
        lambda: f"<section><h2>{words(2, 5)}</h2><div><p>{sentence()}</p></div></section>",
    ]
    body = [f"<h1>{words(3, 8)}</h1>"]
    for _ in range(rng.randint(2, 14)):
        body += [rng.choice(content)(), f"<p>{sentence()}</p>"]
        if rng.random() < 0.25:
            body.append(rng.choice(clutter)())
    around = [f"<header><p>{sentence()}</p></header>", rng.choice(clutter)(), "<article>" + "\n".join(body) + "</article>", rng.choice(clutter)(), f"<footer>&copy; {words(2, 30)}</footer>"]
    return "<html><head><title>t</title></head><body>" + "\n".join(around) + "</body></html>"


def test_against_a_plain_reader():
    rng = random.Random(8)
    for _ in range(300):
        page = made_page(rng)
        reader = Plain()
        reader.feed(page)
        assert main_text(page) == "\n".join(reader.out), page


@pytest.mark.skipif(not PAGES.exists(), reason="needs the driver's tables")
def test_share_that_the_cut_decides():
    blocks = doubtful = overruled = 0
    for page in pq.read_table(PAGES, columns=["html"]).column(0).to_pylist():
        found = blocks_of(page or "")
        score, kept = labels_of(found)
        ties = [0.0] * len(found)
        for i, j, w in edges_of(found):
            ties[i] += w
            ties[j] += w
        blocks += len(found)
        doubtful += sum(abs(s) <= t for s, t in zip(score, ties))
        overruled += sum((s > 0) != k for s, k in zip(score, kept))
    assert doubtful > 0.15 * blocks and overruled > 0
