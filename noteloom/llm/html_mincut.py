"""Main text of web pages by minimum cut.

A page is cut into blocks of text. Each block gets a score, the log odds of being
content, from where it stands (landmarks, roles, words of classes), how much of it
is links, its length and its punctuation; the score's two sides become capacities
to the terminals *content* and *boilerplate*. Blocks next to each other, and blocks
near each other in the document tree, are tied by smoothness edges, which are weak
where a region begins or ends (an article, or an element that looks like clutter).
The minimum cut is the labelling of least total cost. Only a plain mark, such as a
landmark, outweighs all the edges of a block; a word that may mean something else,
a short line or a line of links is doubtful, and goes with what is around it.

Blocks whose terminal capacity outweighs all their edges have the same label in
every minimum cut; they are labelled first and their edges handed to their
neighbours. What is left goes through maximum flow.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm.word_ids import batches_by_size
from noteloom.runtime import ship

# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe "
    "legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template xmp svg object annotation annotation-xml".split())
#: An opening tag of the first kind closes an open element of the second, up to its container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that an inline end tag, or a new paragraph, doesn't look beyond.
WALLS = frozenset("article aside body button dd div dl fieldset figure footer form header html li main menu nav ol section select table td th ul".split())
TABLES = frozenset("dl ol select table ul".split())
FOREIGN = frozenset(("svg",))
#: Of the raw ones, those that end where what they stand in ends, or a block begins, if they aren't closed.
BOUNDED = frozenset(("svg", "object"))
FORMS, FIELDS = frozenset(("form", "fieldset")), frozenset("input select textarea button".split())

LANDMARKS = frozenset("nav footer aside menu button select dialog noscript iframe canvas head optgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
#: Words of classes and ids that mean clutter, on their own or with words of ``PLAIN``.
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promoted cookie cookies consent gdpr ccpa popup modal newsletter subscribe signup login signin "
    "breadcrumb breadcrumbs menu submenu nav navbar navigation toolbar topbar masthead header footer colophon copyright sidebar sidebars comment comments commentlist disqus pagination pager outbrain taboola banner banners "
    # the same in German, French and Spanish
    "werbung anzeige anzeigen kommentar kommentare seitenleiste fusszeile kopfzeile impressum hauptmenue publicite publicites commentaire commentaires piedpage entete publicidad anuncio anuncios comentario comentarios encabezado".split()
)
#: Words that often mean clutter, and may be what a text is about.
DOUBTFUL = frozenset("promotion notice notices alert overlay lightbox subscription register search foot side rail widget widgets related recommended recommendations more share sharing social discussion reply replies respond paging skip toc thread threads response responses reactions feedback hinweis hinweise meldung avis avertissement aviso avisos suche recherche buscar".split())
PLAIN = frozenset(
    "site page main top bottom left right list box area wrap wrapper container section block item bar inner outer primary secondary global form link links unit slot text content group panel row col column div body title head heading "
    "post posts article articles story stories button buttons icon icons id js the and widget block".split()
)
#: Layout of a page with something, not that thing.
WITH = frozenset("has with no not without is".split())
#: Of the words, the ones that count on an article or main element, and those that don't within one, where a header belongs to it.
ARTICLE_CLUTTER = frozenset("ad ads advert advertisement sponsored promo promoted comment comments reply related recommended teaser".split())
OF_ARTICLE = frozenset("header masthead side more skip title".split())
CONTENT = frozenset("article articlebody post postbody entry content story maincontent bodytext main".split())
#: Elements whose marks are about their own line, not a part of the page.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 span a b i em strong blockquote pre".split())

# Log odds; the prior is one for pages with an article and one for pages without.
PRIOR, PRIOR_WITHOUT, LANDMARK, CLEAR, UNCLEAR, HINT, IN_ARTICLE, OUT_OF_ARTICLE = -1.0, 0.3, -6.0, -6.0, -4.0, -1.0, 1.5, -2.5
BORDER = 0.15
IN_LIST = 1.4

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTR = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: What a short line says that speaks for a notice, in the languages above.
_OWNER = re.compile(r"(©|\(c\)|copyright\b)", re.I)
_RIGHTS = re.compile(r"\b(all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\b", re.I)
_COOKIES = re.compile(r"\bcookies?\b", re.I)
_CONSENT = re.compile(r"\b(we use|uses? cookies|accept|consent|agree|policy|preferences|verwende[nt]|nutzen|akzeptieren|einverstanden|utilis(e|ons|er)|accepter|utiliza(mos)?|aceptar)\b", re.I)
_HIDDEN = re.compile(r"\btype\s*=\s*[\"']?hidden", re.I)
_END = re.compile(r"[.!?…:;][\"'»”’)\]]*$")


class Block:
    __slots__ = ("text", "linked", "parent", "grand", "tag", "mark", "article", "content", "region", "order", "form")


class Form:
    """A form or set of fields: what it holds says whether it is one, or the frame of a page."""

    __slots__ = ("above", "chars", "lines", "fields", "article")

    def __init__(self, above: int):
        self.above, self.chars, self.lines, self.fields, self.article = above, 0, 0, 0, False

    def is_form(self) -> bool:
        """No article begins in it, and what text it has is little for its fields. lines: blocks of some length that end as sentences do."""
        return not self.article and self.lines < 2 + self.fields // 4 and self.chars <= 60 + 80 * self.fields


def tag_end(page: str, at: int) -> int:
    """Position of the > that ends the tag at ``at``, not counting those in quoted values; -1 if there is none."""
    k = at
    while True:
        end = page.find(">", k)
        if end < 0:
            return -1
        quote = _QUOTE.search(page, k, end)
        if quote is None:
            return end
        k = page.find(quote[1], quote.end()) + 1
        if k == 0:
            return end


@lru_cache(1 << 14)
def named(name: str, line: bool, in_article: bool) -> float:
    """What a class or id says, as log odds. line: on an element of ``LINES``."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in WITH:
        return 0.0
    if in_article:
        words = [w for w in words if w not in OF_ARTICLE]
    clear, unclear = any(w in CLUTTER for w in words), any(w in DOUBTFUL for w in words)
    if not clear and not unclear:
        return 0.0
    if any(w not in CLUTTER and w not in DOUBTFUL and w not in PLAIN for w in words):
        return HINT
    return CLEAR if clear else UNCLEAR / 2.5 if line else UNCLEAR


def _mark(tag: str, attrs: str, above, number: int):
    """(mark, article, content, region) for an element, from its own marks and those above it."""
    mark, article, content, region = above
    own = 0.0
    if tag in ("article", "main"):
        if not article:
            region = number
        article = True
    elif tag in LANDMARKS or (tag == "header" and not article):
        own = LANDMARK
    if attrs and not attrs.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
        names = [n for key in ("class", "id") if key in found for n in entities.unescape(found[key]).split()]
        anchors = entities.unescape(found.get("id", "")).split() if tag == "section" else ()  # a part of a text is named for what it is about
        if tag in ("article", "main"):
            if any(w.lower() in ARTICLE_CLUTTER for n in names for w in _WORD.findall(n)):
                own = CLEAR
        elif tag not in ("html", "body"):
            own = min([own, *(max(0.0, x) if n in anchors and x > CLEAR else x for n in names for x in [named(n, tag in LINES, article)])])
        role = found.get("role", "").lower()
        if role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            own = LANDMARK
        if not article and (role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"):
            article, region = True, number
        content = content or any(w.lower() in CONTENT for n in names for w in _WORD.findall(n))
    if own <= UNCLEAR or tag in FORMS:
        region = number
    return min(mark, own), article, content, region


class _Open:
    """An open element: what to know of it and of those above it without a walk up the stack."""

    __slots__ = ("tag", "marks", "wall", "row", "holder", "parent", "grand", "form")

    def __init__(self, tag: str, number: int, marks, at: int, above: "_Open | None", form: int):
        self.tag, self.marks, self.form = tag, marks, form
        self.wall = at if tag in WALLS else above.wall if above else 0  # nearest that inline elements and paragraphs don't close
        self.row = at if tag in TABLES else above.row if above else 0
        if tag in BLOCKS:
            self.holder, self.parent, self.grand = tag, number, above.parent if above else 0
        else:
            self.holder, self.parent, self.grand = (above.holder, above.parent, above.grand) if above else ("", 0, 0)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order, with the marks of the elements that hold them. The time is in proportion to the page, however deep it is."""
    out: list[Block] = []
    forms = [Form(-1)]  # the first is the page
    stack = [_Open("", 0, (0.0, False, False, 0), 0, None, 0)]
    places: dict[str, list[int]] = {}  # of the open elements of each name
    unclosed: set[str] = set()
    number = links = 0
    text: list[str] = []
    linked = muted = 0  # muted: place of an open element whose text isn't read

    def flush() -> None:
        nonlocal linked
        words = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if words:
            b = Block()
            top = stack[-1]
            b.text, b.linked, b.order = words, linked, len(out)
            b.tag, b.parent, b.grand = top.holder, top.parent, top.grand
            b.mark, b.article, b.content, b.region = top.marks
            b.form = top.form
            if b.mark > UNCLEAR:
                forms[b.form].chars += len(words)
                forms[b.form].lines += words.count(" ") > 6 and _END.search(words) is not None
            out.append(b)
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if muted:
            return
        text.append(part)
        if links:
            linked += len(part.strip())

    def close(names, wall: int = 0) -> None:
        """Close the innermost open element of one of ``names`` and all in it, if it stands above the place ``wall``."""
        nonlocal links, muted
        at = max((places[n][-1] for n in names if places.get(n)), default=0)
        if at > wall:
            for e in reversed(stack[at:]):
                places[e.tag].pop()
                links -= e.tag == "a"
            del stack[at:]
            muted = 0 if at <= muted else muted

    at = 0
    size = len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = size if end < 0 else end + 3
            else:
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            continue
        closing = after == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if name is None:
            if closing and lt + 2 < size:  # a bogus comment
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        end = tag_end(page, name.end())
        if end < 0:
            break  # the page ends within a tag
        tag = name[0].lower()
        attrs = page[name.end() : end]
        at = end + 1
        if closing:
            if tag in BLOCKS:
                flush()
                close((tag,))
            elif places.get(tag):
                close((tag,), stack[-1].wall)
            elif tag == "br":
                add(" ")
            continue
        if tag in FIELDS and not _HIDDEN.search(attrs):
            forms[stack[-1].form].fields += 1
        shut = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at) if tag in RAW and not (attrs.endswith("/") and tag in FOREIGN) and tag not in unclosed else None
        if tag in RAW and shut is None and tag in BOUNDED and not attrs.endswith("/"):
            unclosed.add(tag)  # nor is any after it
            if not muted:
                muted = len(stack)
        elif tag in RAW and not (attrs.endswith("/") and tag in FOREIGN):
            if shut is None:
                break
            gt = page.find(">", shut.end())
            at = size if gt < 0 else gt + 1
            if tag == "textarea":
                add(" ")
            continue
        if tag in BLOCKS:
            if muted:
                close((stack[muted].tag,))
            flush()
            if tag != "option":
                close(("p",), stack[-1].wall)
            if tag in CLOSES:
                close(CLOSES[tag], stack[-1].row)
        elif tag == "br":
            add(" ")
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCKS):
            number += 1
            places.setdefault(tag, []).append(len(stack))
            form = stack[-1].form
            if tag in FORMS:
                forms.append(Form(form))
                form = len(forms) - 1
            marks = _mark(tag, attrs, stack[-1].marks, number)
            forms[form].article |= marks[1] and not stack[-1].marks[1]
            stack.append(_Open(tag, number, marks, len(stack), stack[-1], form))
            links += tag == "a"
    flush()
    for f in reversed(forms[1:]):  # what a form holds, all that hold it do
        above = forms[f.above]
        above.chars, above.lines, above.fields, above.article = above.chars + f.chars, above.lines + f.lines, above.fields + f.fields, above.article or f.article
    real = [False]
    for f in forms[1:]:
        real.append(real[f.above] or f.is_form())
    for b in out:
        if real[b.form]:
            b.mark = min(b.mark, LANDMARK)
    return out


def lists_of(blocks: list[Block]) -> list[tuple[int, int]]:
    """The runs of items of one list: (first, end)."""
    out, first = [], 0
    for i in range(1, len(blocks) + 1):
        if i == len(blocks) or blocks[i].tag != "li" or blocks[first].tag != "li" or blocks[i].grand != blocks[first].grand:
            if blocks[first].tag == "li":
                out.append((first, i))
            first = i
    return out


def scores(blocks: list[Block]) -> list[float]:
    """Log odds of being content. The weights are set by hand, so that what may be read in two ways ends up near 0."""
    main = [b for b in blocks if b.article and b.mark > UNCLEAR]
    inside, short = bool(main), max((b.text.count(" ") for b in main), default=9) < 7  # where no line is long, length and full stops say nothing
    listed = {i for first, end in lists_of(blocks) if end - first > 1 and blocks[first].article for i in range(first, end)}  # that items are short, or links, is no mark there
    out = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        s = b.mark + (PRIOR if inside else PRIOR_WITHOUT)
        if b.article:
            s += IN_ARTICLE
        elif inside:
            s += OUT_OF_ARTICLE
        if b.content:
            s += 1.0
        s += {"h1": 1.0, "p": 0.5, "blockquote": 0.5, "pre": 0.5, "li": -0.3}.get(b.tag, 0.3 if b.tag in ("h2", "h3", "h4", "dd", "figcaption", "td") else 0.0)
        if not (short and b.article) and not (i in listed and words < 8):
            s += min(1.5, math.log2(1 + words) / 2 - 1.5)
            s += 0.7 if _END.search(b.text) else -0.3
        s -= (0.15 if i in listed else 1.5 if b.article else 3.0) * min(1.0, b.linked / max(1, len(b.text)))
        if words < 40 and (_OWNER.match(b.text) or not b.article and _RIGHTS.search(b.text)):
            s -= 4
        if words < 60 and _COOKIES.search(b.text) and _CONSENT.search(b.text):
            s -= 2 if b.article else 4
        out.append(s)
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: to the next block of the page, and to the next one with the same parent or grandparent.

    The items of a list within an article are also tied to the blocks before and after
    it, each with its part of what ties the list.
    """
    edges: dict[tuple[int, int], float] = {}
    parents: dict[int, int] = {}
    grands: dict[int, int] = {}
    for i, b in enumerate(blocks):
        ties = [(i - 1, 0.6)] if i else []
        if b.parent in parents:
            ties.append((parents[b.parent], 1.0))
        if b.grand in grands:
            ties.append((grands[b.grand], 0.7))
        for j, w in ties:
            edges[j, i] = edges.get((j, i), 0) + (w if blocks[j].region == b.region else w * BORDER)
        parents[b.parent] = grands[b.grand] = i
    for first, end in lists_of(blocks):
        for k in range(first, end) if blocks[first].article else ():
            for a, c in ((first - 1, k), (k, end)):
                if a >= 0 and c < len(blocks) and blocks[a].region == blocks[c].region:
                    edges[a, c] = edges.get((a, c), 0) + IN_LIST / (end - first)
    return [(i, j, w) for (i, j), w in edges.items()]


def max_flow_side(source: list[float], sink: list[float], edges) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; by shortest augmenting paths in level graphs."""
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i in range(n):
        both = min(source[i], sink[i])
        link(s, i, source[i] - both, 0)
        link(i, t, sink[i] - both, 0)
    for i, j, w in edges:
        link(i, j, w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[a] < len(graph[a]):
                e = graph[a][nxt[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
                nxt[a] += 1
                continue
            path.append(e)
            a = to[e]


def min_cut(score: list[float], edges) -> list[bool]:
    """Labels (content or not) of least total cost."""
    n = len(score)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0) + w
        near[j][i] = near[j].get(i, 0) + w
    soft = [math.log1p(math.exp(-abs(x))) for x in score]
    source = [max(x, 0) + y for x, y in zip(score, soft)]
    sink = [max(-x, 0) + y for x, y in zip(score, soft)]
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(source[i] - sink[i]) <= sum(near[i].values()):
            continue
        label[i] = source[i] > sink[i]
        for j, w in near[i].items():
            (source if label[i] else sink)[j] += w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    place = {i: k for k, i in enumerate(left)}
    rest = [(place[i], place[j], w) for i in left for j, w in near[i].items() if i < j]
    for i, side in zip(left, max_flow_side([source[i] for i in left], [sink[i] for i in left], rest) if left else []):
        label[i] = side
    return [bool(x) for x in label]


def labels_of(blocks: list[Block]) -> tuple[list[float], list[bool]]:
    """Each block's score, and whether the minimum cut puts it with the content."""
    score = scores(blocks)
    return score, min_cut(score, edges_of(blocks))


def main_text(page: str | None) -> str:
    """The main text of a page, a line for each block; empty if it has none."""
    blocks = blocks_of(page or "")
    return "\n".join(b.text for b, k in zip(blocks, labels_of(blocks)[1]) if k)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every row of ``pages``: page_id, url, text, n_chars (code points).

    Null html has an empty text. Ids and urls may be null or repeat; each row
    gives one row. Pages are read whole, however long or deep. An empty table gives
    an empty result. Columns other than those named aren't read, whatever their
    names. No shuffle: rows stay where they are.
    """
    ship(pages.sparkSession)
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            for group in batches_by_size(rows, lambda r: 100 + len(r[2] or "")):
                texts = [main_text(r[2]) for r in group]
                cols = [[r[0] for r in group], [r[1] for r in group], texts, [len(t) for t in texts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
