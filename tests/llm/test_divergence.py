"""Divergence of sources against sums over every kept term, in Python's integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from noteloom.llm.divergence import source_divergence, terms_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def small(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def slow(rows, least_docs, ranks=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(small(text or ""))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        mine = [s for a, s in groups if a == lang]

        def shares(of):
            own = {t: sum(count[lang, s][t] for s in of) for t in kept}
            total = sum(own.values())
            return {t: 1 + 10**9 * (n + 2) // (total + 2 * len(kept)) for t, n in own.items()}

        p, every = shares([source]), shares(mine)
        pairs = []
        for s in mine:
            if s != source:
                q = shares([s])
                pairs.append((s, sum(f(p[t], q[t]) for t in kept)))
        terms = [(t, f(p[t], every[t])) for t in kept if count[lang, source][t] and p[t] > every[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out, key=str)


def made(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("term", "n", "salt", "value"):  # names that clash with the operator's own
        df = df.withColumn(c, df.doc_id)
    return sorted((tuple(r) for r in source_divergence(df, **kw).collect()), key=str)


def test_against_sums_over_all_terms(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["É", "naïve", "日本", "ΣΑΣ"]
    rows = []
    for i in range(500):
        source = None if i % 41 == 0 else "hot" if i % 3 == 0 else f"s{rng.integers(6)}"
        lang = [None, "en", "en", "fr"][rng.integers(4)]
        weights = rng.zipf(1.6, 30) % len(words)
        rows.append((i, " ".join(words[k].upper() if k % 5 == 0 else words[k] for k in weights), lang, source))
    rows += [(900, None, "en", "only nulls"), (901, "", "en", "only empties"), (902, "a 1 b-2 c", "lone", "x"), (902, "a 1 b-2 c", "lone", "x"), (903, "zz " * 30_000, "en", "s1")]
    assert made(spark, rows) == slow(rows, 10)
    assert made(spark, rows, least_docs=2) == slow(rows, 2)


def test_nothing_kept_and_empty(spark):
    rows = [(1, "one two", "en", "a"), (2, "three", "en", "b"), (3, None, None, None)]
    assert made(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert made(spark, []) == []


@pytest.mark.parametrize("text", ["", "A-b_c d\x7fE\x1cf", "Straße ÀB1é 日本語x", "\x00a\tb\nc", "İ Σ ſ K"])
def test_terms(text):
    assert [t.decode() for t in terms_of(text)] == TERM.findall(small(text))
