import random
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from noteloom.llm.components import components
from noteloom.llm.simhash import build, close_pairs, drop_near_copies, fingerprint, near_groups, near_links, route
from noteloom.runtime import Scratch


def slow_fingerprint(text):
    words = [w for w in "".join(c if c not in "\t\n\x0b\x0c\r" else " " for c in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" abcÉéA\n\t\x1c\x85", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == slow_fingerprint(text)


def groups_of(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def near(prints):
    return [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 3]


def some_prints(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.choice([0, 0, 0, 1, 5])):
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_close_pairs_and_route_find_all():
    prints = some_prints(1500, 3)
    arr = np.array(prints, "<u8")
    want = {frozenset(p) for p in near(prints)}
    got = {frozenset((prints[i], prints[j])) for a, b in close_pairs(arr, np.ones(len(arr), bool), few=32) for i, j in zip(a, b)}
    assert got == want
    tree = build(arr[:400], 16)
    got = set()
    for _, part, home in route(tree, arr, np.ones(len(arr), bool)):
        for a, b in close_pairs(part, home, few=16):
            got |= {frozenset((int(part[i]), int(part[j]))) for i, j in zip(a, b)}
    assert got == want


def test_near_links_span_the_same_groups(spark):
    prints = some_prints(3000, 5)
    scratch = Scratch(spark, "test")
    signed = [int(x) for x in np.array(prints, "<u8").view("<i8")]
    table = scratch.write(spark.createDataFrame([(x,) for x in signed], "fp long"), "prints")
    got = groups_of((r.u, r.v) for r in near_links(table, scratch).collect())
    back = dict(zip(prints, signed))
    want = groups_of((back[a], back[b]) for a, b in near(prints))
    assert got == want


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)]
    links += [(5, 4), (7, 8)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "test")).collect()}
    want = groups_of(x for x in links if x[0] != x[1])
    assert {k: v for k, v in got.items() if k in want} == want


def test_near_groups(spark, odd_docs):
    base = [" ".join(random.Random(i).choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=300)) for i in range(6)]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    for i, t in enumerate(base):
        rows += [(100 + 10 * i, t), (101 + 10 * i, t + " tail"), (102 + 10 * i, t.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [fingerprint(t) for _, t in rows]
    root = {p: p for p in prints} | groups_of(near(sorted(set(prints))))
    least = defaultdict(lambda: 1 << 62)
    for (d, _), p in zip(rows, prints):
        least[root[p]] = min(least[root[p]], 1 << 62 if d is None else d)
    want = sorted((str(d), f"{p:016x}", str(None if least[root[p]] == 1 << 62 else least[root[p]])) for (d, _), p in zip(rows, prints))
    got = near_groups(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert sum(r.kept for r in got) == len(set(root.values()))
    assert drop_near_copies(odd_docs).schema == odd_docs.schema
    assert near_groups(docs.limit(0)).collect() == [] and drop_near_copies(docs.limit(0)).collect() == []
