"""Packing by exact complements: rules of the contract, ids of the library, and plans against the fewest sequences there can be."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noteloom.llm.best_fit import Places, Sums, best_fit, pack_whole, plan_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fewest(lengths, tokens):
    """The fewest sequences, by trying all."""
    best = len(lengths)

    def put(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for i in range(len(room)):
            if room[i] >= lengths[k] and room[i] not in room[:i]:
                put(k + 1, room[:i] + [room[i] - lengths[k]] + room[i + 1 :])
        put(k + 1, [*room, tokens - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_plans_near_the_fewest(lengths):
    plan = plan_sequences(Counter(lengths), 20)
    assert Counter({k: v for k, v in sum((Counter({a: n * times for a, n in Counter(ls).items()}) for times, ls in plan), Counter()).items()}) == Counter(lengths)
    assert all(sum(ls) <= 20 and times > 0 for times, ls in plan)
    size = sum(times for times, _ in plan)
    assert fewest(lengths, 20) <= size <= fewest(lengths, 20) + 1
    assert size <= sum(times for times, _ in best_fit(Counter(lengths), 20))


@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.data())
@settings(max_examples=60, deadline=None)
def test_sums_are_those_of_what_is_left(lengths, data):
    left = np.bincount(lengths, minlength=31)
    sums = Sums(left)
    for _ in range(4):
        there = [int(a) for a in np.flatnonzero(left)]
        for index, k in ((sums.pairs, 2), (sums.triples, 3)):
            want = Counter(t for t in map(sum, combinations_with_replacement(there, k)) if t <= 30)
            assert {s: int(n) for s, n in enumerate(index) if n} == dict(want)
        if not there:
            break
        sums.use({data.draw(st.sampled_from(there)): 1}, 1)


def test_exact_complements_are_used():
    """Lengths made so that singles, pairs and triples fill every sequence."""
    counts = Counter()
    for parts, n in (((600, 424), 50), ((700, 200, 124), 30), ((500, 300, 130, 94), 20), ((1024,), 7)):
        for a in parts:
            counts[a] += n
    plan = plan_sequences(counts)
    assert sum(times for times, _ in plan) == 107 and all(sum(ls) == 1024 for _, ls in plan)


@pytest.mark.parametrize("seed", range(4))
def test_large_counts(seed):
    """Within two in a thousand of the least that any packing needs, for a million and for 10^12 pieces alike, in as many entries."""
    rng = np.random.default_rng(seed)
    one = Counter(np.clip(rng.lognormal(5 + seed / 2, 1, 1_000_000).astype(int), 1, 1023).tolist())
    for scale in (1, 10**6):
        counts = {a: n * scale for a, n in one.items()}
        plan = plan_sequences(counts)
        least = max(-(-sum(a * n for a, n in counts.items()) // 1024), sum(n for a, n in counts.items() if a > 512))
        assert sum(times for times, _ in plan) <= least * 1.002 + 5 and len(plan) < 5000


def test_places_cover_every_sequence_once():
    counts = {1: 2500, 3: 11, 500: 40, 513: 9, 1024: 3}
    plan = plan_sequences(counts)
    places = Places(plan)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = places.of(length, rank)
    held = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        held[s].append((o, n))
    assert sorted(held) == list(range(places.sequences))
    for pieces in held.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024


def held_to_the_contract(rows, texts, tokens=1024):
    """rows: of the operator; texts: (doc_id, text), of which ids may repeat."""
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in texts:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % tokens or tokens
        cuts = [0, *range(first, len(ids) + 1, tokens)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= tokens
    return len(held)


def test_documents(spark, odd_docs):
    rows = pack_whole(odd_docs, PATH).collect()
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    held_to_the_contract(rows, texts)
    assert pack_whole(odd_docs.limit(0), PATH).count() == 0


def test_many_copies_over_many_tasks(spark):
    """A third of all rows are one text; ranks of one length run over all tasks."""
    docs = spark.range(0, 3000, 1, 16).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the very same text' ELSE repeat('word ', cast(id % 1500 AS int)) END AS text", "'x' AS length", "1 AS task")
    rows = pack_whole(docs, PATH).collect()
    n = held_to_the_contract(rows, [(r.doc_id, r.text) for r in docs.collect()])
    total = sum(r.length for r in rows)
    assert n <= 1.01 * max(total / 1024, sum(r.length > 512 for r in rows)) + 2


def test_ids_come_along(spark):
    docs = spark.createDataFrame([(1, "some words " * 900), (2, None)], "doc_id long, text string")
    rows = pack_whole(docs, PATH, with_ids=True).collect()
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    ids = b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)) if r.doc_id == 1)
    assert np.frombuffer(ids, "<u4").tolist() == [*Tokenizer.from_file(PATH).encode("some words " * 900, add_special_tokens=False).ids, 2]
