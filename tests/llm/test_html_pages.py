"""Plain pages of kinds that real sites have, and pages whose class names say nothing."""

import random

import pytest

from noteloom.llm.html_mincut import blocks_of, edges_of, labels_of, main_text

ONE, TWO = "The first paragraph of this page has a fair number of words in it.", "The second paragraph goes on for a while as well, and then it ends."
BOTH = f"<p>{ONE}</p><p>{TWO}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm><input type=hidden name=state value=x><article>{BOTH}</article></form></body>",
        f"<body><form id=aspnetForm><input type=hidden name=state value=x><div>{BOTH}</div></form></body>",
        f"<body><form><nav><a href=/>Home</a></nav><input name=q><button>Go</button><div>{BOTH}</div></form></body>",
        f"<body><form><div>{BOTH}</div><form><label>Mail</label><input name=mail><button>Send</button></form></form></body>",
        f"<body><fieldset><article>{BOTH}</article></fieldset></body>",
    ],
)
def test_a_form_around_a_page(page):
    assert main_text(page) == f"{ONE}\n{TWO}"


def test_forms_still_go():
    for form in ("<form><label>Your name</label><input name=n><label>Your mail</label><input name=m><textarea></textarea><button>Send</button></form>", "<form><p>Get the letter every week, with all that is new on this site.</p><input name=m><button>Join</button></form>"):
        assert main_text(f"<article><p>{ONE}</p>{form}<p>{TWO}</p></article>") == f"{ONE}\n{TWO}", form


@pytest.mark.parametrize("linked", [False, True])
@pytest.mark.parametrize("items", [["Salt", "Flour", "Two eggs"], ["Salt"], ["Salt", "Flour", "Two eggs", "Milk", "Some oil", "Sugar", "Yeast", "Water"]])
def test_short_lists_of_articles(linked, items):
    rows = "".join(f"<li><a href=/x>{x}</a></li>" if linked else f"<li>{x}</li>" for x in items)
    for kind in ("ul", "ol"):
        assert main_text(f"<body><article><p>{ONE}</p><{kind}>{rows}</{kind}><p>{TWO}</p></article></body>") == "\n".join([ONE, *items, TWO])


def test_menus_still_go():
    rows = "".join(f"<li><a href=/{x}>{x}</a></li>" for x in ("Home", "News", "About", "Contact"))
    for page in (f"<body><ul>{rows}</ul><div>{BOTH}</div></body>", f"<body><ul>{rows}</ul><article>{BOTH}</article><ul>{rows}</ul></body>", f"<article><ul class=menu>{rows}</ul>{BOTH}</article>"):
        assert main_text(page) == f"{ONE}\n{TWO}", page


def test_a_section_may_be_a_discussion():
    page = f"<body><div>{BOTH}<section id=discussion><h2>Discussion</h2><p>What all of this means is set out in the next few lines.</p></section></div></body>"
    assert main_text(page) == f"{ONE}\n{TWO}\nDiscussion\nWhat all of this means is set out in the next few lines."


def test_formulas_and_pictures():
    formula = "<math><mi>a</mi><mo>=</mo><mi>b</mi><annotation encoding=tex>a=b</annotation></math>"
    assert main_text(f"<article><p>The relation {formula} holds for all of these.</p></article>") == "The relation a=b holds for all of these."
    for broken in ("<svg viewbox=x><path d=y><text>label</text>", "<object data=x>no player"):
        assert main_text(f"<article><p>Before it {broken}</p><p>{ONE}</p><p>{TWO}</p></article>") == f"Before it\n{ONE}\n{TWO}", broken
        assert main_text(f"<article><div>{broken}<p>{ONE}</p></div><p>{TWO}</p></article>") == f"{ONE}\n{TWO}", broken
    assert main_text(f"<article><p>Seen <svg><title>no</title><g/></svg> here.</p><p>{ONE}</p></article>") == f"Seen here.\n{ONE}"


@pytest.mark.parametrize(
    "clutter",
    [
        "<div class=thread><div><b>Ann</b><p>I liked this very much, thank you for writing it all down.</p></div><div><b>Bo</b><p>So did I, but for the end of it.</p></div></div>",
        "<div class=responses><p>I liked this very much, thank you for writing it all down.</p><p>So did I.</p></div>",
        "<div><p>We use cookies to make this site better. Please accept them or read our policy.</p><button>OK</button></div>",
        "<div><p>Diese Website verwendet Cookies, um Inhalte zu verbessern.</p></div>",
        "<div class=hinweis><p>Bitte beachten Sie unsere neuen Bedingungen für alle Leser.</p></div>",
        "<div class=werbung><p>Jetzt kaufen und viel Geld sparen, nur noch heute.</p></div>",
        "<div class=publicidad><p>Compre ahora y ahorre mucho dinero, solo por hoy.</p></div>",
        "<div class=commentaires><p>Un très bon texte, merci beaucoup pour tout cela.</p></div>",
        "<div>All rights reserved.</div>",
        "<div>Example Press 2021. Tous droits réservés.</div>",
    ],
)
def test_clutter_without_english_names(clutter):
    assert main_text(f"<body><div>{BOTH}</div>{clutter}</body>") == f"{ONE}\n{TWO}"
    assert main_text(f"<body><article>{BOTH}</article>{clutter}</body>") == f"{ONE}\n{TWO}"


def test_texts_about_clutter_stay():
    for line in ("The baker said that cookies sell best when the weather is cold and the days are short.", "In court, the defence said that all of the rights of the people were kept by the new law of that year, and that nobody had lost any."):
        assert main_text(f"<article><p>{ONE}</p><p>{line}</p><p>{TWO}</p></article>") == f"{ONE}\n{line}\n{TWO}"


def page_of_no_names(rng):
    """A page whose classes are hashes, as style sheets of frameworks make them; (page, text)."""
    name = lambda: "".join(rng.choices("bcdfghjklmnpqrstvwxz0123456789", k=6))
    words = lambda a, b: " ".join(rng.choices("some plain words that stand here in long rows of text and go on".split(), k=rng.randint(a, b)))
    lines, body = [], []
    for _ in range(rng.randint(3, 9)):
        t = words(10, 40).capitalize() + "."
        lines.append(t)
        body.append(f"<p class={name()}>{t}</p>")
        if rng.random() < 0.4:
            items = [words(1, 3) for _ in range(rng.randint(2, 5))]
            lines += items
            body.append(f"<ul class={name()}>" + "".join(f"<li class={name()}>{x}</li>" for x in items) + f"</ul><p class={name()}>{(t := words(10, 30).capitalize() + '.')}</p>")
            lines.append(t)
    links = "".join(f"<li class={name()}><a href=/{name()}>{words(1, 2)}</a></li>" for _ in range(6))
    foot = f"<div class={name()}><a href=/t>Terms</a> | <a href=/c>Contact</a></div><div class={name()}>© 2023 {words(1, 2)}</div>"
    return f"<html><body class={name()}><div class={name()}><ul class={name()}>{links}</ul></div><article class={name()}>{''.join(body)}</article>{foot}</body></html>", "\n".join(lines)


def test_pages_of_no_names():
    rng = random.Random(6)
    blocks = doubtful = overruled = 0
    for _ in range(200):
        page, text = page_of_no_names(rng)
        assert main_text(page) == text, page
        found = blocks_of(page)
        score, kept = labels_of(found)
        ties = [0.0] * len(found)
        for i, j, w in edges_of(found):
            ties[i] += w
            ties[j] += w
        blocks += len(found)
        doubtful += sum(abs(s) <= t for s, t in zip(score, ties))
        overruled += sum((s > 0) != k for s, k in zip(score, kept))
    print(f"of {blocks} blocks {doubtful} aren't decided by their own score, and {overruled} are overruled")
    assert doubtful > 0.15 * blocks
