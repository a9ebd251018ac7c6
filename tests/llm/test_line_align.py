import random
from collections import defaultdict

from hypothesis import given
from hypothesis import strategies as st

from noteloom.llm.line_align import MIN_WORDS, aligned_lines, chain, delete_repeated_lines, runs_of


def slow_chain(pairs):
    best = [1] * len(pairs)
    for i, (a, b) in enumerate(pairs):
        for j, (c, d) in enumerate(pairs[:i]):
            if c < a and d < b:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=12).map(sorted))
def test_chain_is_longest(pairs):
    got = [pairs[i] for i in chain(pairs)]
    assert all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
    assert len(got) == slow_chain(pairs)


def test_runs():
    text = "one two three four five\n\nsix\nseven eight\nnine ten eleven\nsix"
    spans = [(a, b) for _, a, b in runs_of(text)]
    assert (0, 0) in spans and (2, 4) in spans and (3, 4) in spans
    assert all(sum(len(x.split()) for x in text.split("\n")[a : b + 1]) >= MIN_WORDS for a, b in spans)
    keys = [k for k, _, _ in runs_of("a b c d e\n" * 4)]
    assert len(set(keys)) == 4 == len(keys)
    assert runs_of(None) == runs_of("") == runs_of("a b\nc d") == []


def brute(rows):
    """All runs of all earlier documents, first holders first, then an alignment of each pair."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first = {}
    out = {}
    for i in order:
        own = runs_of(rows[i][1])
        shared = [(*first[k], a, b) for k, a, b in own if k in first]
        lines = aligned_lines([(o, a, b, there) for o, there, a, b in shared])
        for k, a, _ in own:
            first.setdefault(k, (i, a))
        text = rows[i][1]
        out[i] = None if text is None else "\n".join(x for j, x in enumerate(text.split("\n")) if j not in lines)
    return out


def test_against_brute_force(spark, odd_docs):
    rng = random.Random(4)
    line = lambda n: " ".join(rng.choices("a b c d e f g h i j k l m n o p".split(), k=n))
    pool = [line(rng.randint(1, 12)) for _ in range(60)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(55)
            parts += pool[k : k + rng.randint(1, 5)] if rng.random() < 0.6 else [line(8)]
        rows.append((200 + i, "\n".join(parts)))
    rows += [(500, rows[-1][1]), (500, rows[-1][1]), (None, rows[-2][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, uid int").coalesce(1)
    want = defaultdict(list)
    for i, t in brute(rows).items():
        want[rows[i][0]].append(str(t))
    got = defaultdict(list)
    for r in delete_repeated_lines(docs).collect():
        got[r.doc_id].append(str(r.text))
        assert r.n_deleted <= r.n_lines
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_copies_go(spark):
    text = "The first line of some text.\nshort\nThe first line of some text.\nAnother line that ends it here."
    docs = spark.createDataFrame([(2, text), (1, text), (3, "Something new stands here now.\n" + text), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in delete_repeated_lines(docs).collect()}
    assert got == {1: text, 2: "", 3: "Something new stands here now.", 4: None}
    assert delete_repeated_lines(docs.limit(0)).collect() == []


def every_earlier(rows):
    """Alignments over first-held runs, and of each document with every earlier one over all runs that the two share."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    held = defaultdict(list)
    out = {}
    for i in order:
        own = runs_of(rows[i][1])
        lines = {*aligned_lines([(o, a, b, there) for k, a, b in own for o, there in held[k][:1]])}
        lines |= {*aligned_lines([(o, a, b, there) for k, a, b in own for o, there in held[k]])}
        for k, a, _ in own:
            held[k].append((i, a))
        text = rows[i][1]
        out[i] = (text and "\n".join(x for j, x in enumerate(text.split("\n")) if j not in lines), len(lines))
    return out


def test_every_earlier_document_is_aligned(spark, odd_docs):
    rng = random.Random(11)
    blocks = ["\n".join(" ".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 3))) for _ in range(14)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i in range(150):
        rows.append((200 + i, "\n".join(rng.sample(blocks, rng.randint(2, 6)))))
        if rng.random() < 0.3:
            rows.append((200 + i, rows[-1][1].replace("\n", "\n\n")))
    rows += [(None, rows[-1][1]), (None, rows[40][1])]
    want = every_earlier(rows)
    assert sum(want[i][0] != t for i, t in brute(rows).items()) > 10  # first holders alone leave lines behind
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.text, r.n_deleted) for r in delete_repeated_lines(docs, every=True).collect()]
    assert sorted(map(str, got)) == sorted(str((rows[i][0], *w)) for i, w in want.items())


def test_copy_of_second_holder_goes(spark):
    p, q = "One block of five words\nand some more after it", "Quite another block stands here\nwith its own second line"
    docs = spark.createDataFrame([(1, f"{p}\n{q}"), (2, f"{q}\n{p}"), (3, f"{q}\n{p}")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in delete_repeated_lines(docs, every=True).collect()}
    assert got[3] == "" and got[2] in (p, q)
