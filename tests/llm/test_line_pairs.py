"""Deleted lines against plain alignments of all pairs of documents; nothing of the operator is used but its result."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from noteloom.llm.line_align import delete_repeated_lines

DATA = Path("/root/testdata/sf0.001")


def keyed(text):
    """(line number, (words, which time)) of the lines with five words or more."""
    seen, out = Counter(), []
    for i, line in enumerate((text or "").split("\n")):
        words = tuple(line.split())
        if len(words) >= 5:
            out.append((i, (words, seen[words])))
            seen[words] += 1
    return out


def longest(own, other):
    """Length of the longest common subsequence of keys that occur once in each."""
    at = {k: i for i, (_, k) in enumerate(other)}
    places = [at[k] for _, k in own if k in at]
    best = []
    for i, p in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j] < p), default=0))
    return max(best, default=0)


def check(rows, got):
    """For each pair of documents, as many shared lines of the later one are gone as align at least; returns the lines that align."""
    lines = {d: keyed(t) for d, t in rows}
    holders = defaultdict(set)
    aligned = 0
    for d, text in sorted(rows):
        kept = Counter(tuple(x.split()) for x in (got[d] or "").split("\n"))
        gone = set()
        for i, (words, k) in reversed(lines[d]):
            if kept[words] > 0:
                kept[words] -= 1
            else:
                gone.add((words, k))
        for e in sorted({e for _, k in lines[d] for e in holders[k]}):
            n = longest(lines[d], lines[e])
            shared = {k for _, k in lines[d]} & {k for _, k in lines[e]}
            assert len({w for w, _ in shared & gone}) >= len({w for w, _ in shared}) - (len(shared) - n), (d, e)
            aligned += n
        if not any(holders[k] for _, k in lines[d]):
            assert got[d] == text
        for _, k in lines[d]:
            holders[k].add(d)
    return aligned


def test_all_pairs_of_made_up_documents(spark):
    rng = random.Random(21)
    pool = [" ".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(5, 9))) for _ in range(70)]
    rows = [(i, "\n".join(rng.sample(pool, rng.randint(0, 12)) if rng.random() < 0.7 else pool[(k := rng.randrange(60)) : k + rng.randint(1, 10)])) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = delete_repeated_lines(docs, every=True).collect()
    assert check(rows, {r.doc_id: r.text for r in out}) > 1000
    assert {r.doc_id: r.n_lines for r in out} == {d: len(t.split("\n")) for d, t in rows}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_all_pairs_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check(rows, {r.doc_id: r.text for r in delete_repeated_lines(docs, every=True).collect()}) > 0
