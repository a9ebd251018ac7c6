"""Bounds of caches, limits of sequences, and texts with other white space than single spaces."""

import random
import sys
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noteloom.llm import word_ids as W
from noteloom.llm.packing import Packer, pack_texts

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
CUTS = {WORD: W.cut_lowered, BYTE: W.cut_before_spaces}
TOKENIZERS = {p: Tokenizer.from_file(p) for p in CUTS}
ENCODERS = {p: W.library_encoder(open(p, encoding="utf-8").read()) for p in CUTS}


TABLES = {p: W.Table(1 << 14) for p in CUTS}
PARTS = st.one_of(st.sampled_from([*"  \n\n\t\x01\r'sabTHE.,1<|>\x85\xa0　\x1c ΣİéǺ", "<|endoftext|>", "don't "]), st.characters(codec="utf-8", max_codepoint=0x2FFF))


def raw_ids(path, text):
    return np.array(TOKENIZERS[path].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path", CUTS)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(PARTS, max_size=40).map("".join), max_size=6))
def test_many_texts_at_once(path, texts):
    want = [raw_ids(path, t) for t in texts]
    assert W.keyed_ids(texts, CUTS[path], ENCODERS[path], W.Kept()) == want
    assert W.keyed_ids(texts, CUTS[path], ENCODERS[path], TABLES[path]) == want


def test_texts_with_other_white_space_are_cut():
    text = "\t".join(f"word{i}  and more\n\n\n\nlines" for i in range(300)) + "  "
    chunks = W.cut_before_spaces(text)
    assert "".join(chunks) == text and max(map(len, chunks)) < 12
    kept = W.Table()
    assert W.keyed_ids([text], W.cut_before_spaces, ENCODERS[BYTE], kept) == [raw_ids(BYTE, text)]
    assert len(kept.keys) < 1000


def test_kept_is_bounded_in_bytes():
    kept = W.Kept(most_bytes=1 << 20)
    long = [f"{i}" + "x" * 100_000 for i in range(50)]
    assert kept.values(long, lambda keys: [k.encode() for k in keys]) == [k.encode() for k in long]
    assert not kept.new and not kept.old
    for i in range(0, 40_000, 500):
        kept.values([f"{j}" + "y" * 200 for j in range(i, i + 500)], lambda keys: [b"0" * 300] * len(keys))
    held = sum(sys.getsizeof(k) + sys.getsizeof(v) for d in (kept.new, kept.old) for k, v in d.items())
    assert 0 < held < 1 << 21


def test_table_is_bounded_in_bytes():
    table = W.Table(1 << 20)
    some = W.pa.array([f"{i}" + "x" * (200_000 if i % 50 == 0 else 30) for i in range(60_000)], W.pa.large_string())
    for i in range(0, len(some), 700):
        part = some.slice(i, 700)
        assert table.values(part, lambda keys: keys.cast(W.pa.large_binary())).cast(W.pa.large_string()).equals(part)
        assert table.nbytes() <= 1 << 20
    assert len(table.keys) > 100


def test_a_worker_holds_the_caches_of_one_operator():
    first = W.cache("test one", list)
    assert W.cache("test one", list) is first
    W.cache("test two", list)
    assert W.cache("test one", list) is not first


def lengths_of(rows):
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    return sorted(used.values())


def test_many_short_documents_need_no_padding(spark):
    docs = spark.range(8000).selectExpr("id AS doc_id", "CASE WHEN id % 33 = 0 THEN repeat('some words here ', cast(id % 50 AS int)) END AS text").coalesce(1)
    rows = pack_texts(docs, BYTE).collect()
    lengths = lengths_of(rows)
    assert sum(lengths) == sum(len(raw_ids(BYTE, "some words here " * (i % 50) if i % 33 == 0 else "")) // 4 + 1 for i in range(8000))
    assert all(n == 1024 or n & (n - 1) == 0 for n in lengths)


def test_cut_items_keep_the_limit_on_loss():
    """The loss-bearing tokens of an item are its last ones."""
    rng = random.Random(3)
    sizes = {i: (80, 40) for i in range(20)} | {i: ((t := rng.randint(1, 300)), rng.randint(0, t)) for i in range(20, 300)}
    packer = Packer(tokens=100, segments=5, loss=30, window=16)
    out = [x for i, (t, loss) in sizes.items() for x in packer.add(i, t, loss)] + list(packer.finish())
    got = defaultdict(list)
    for _, pieces in out:
        at = borne = 0
        for i, start, length, offset in pieces:
            t, loss = sizes[i]
            assert offset == at and length > 0
            at += length
            borne += max(0, start + length - max(start, t - loss))
            got[i].append((start, length))
        assert at <= 100 and borne <= 30 and len(pieces) <= 5
    for i, (t, _) in sizes.items():
        at = 0
        for start, length in sorted(got[i]):
            assert start == at
            at += length
        assert at == t


def test_whole_items_over_a_limit_are_named(spark):
    docs = spark.createDataFrame([(1, "word " * 2000, 3), (2, "word", 1), (3, "word " * 50, 40)], "doc_id long, text string, borne long")
    got = {r.doc_id: r.over_limit for r in pack_texts(docs, BYTE, loss=20, cut=False, loss_col="borne").collect()}
    assert got == {1: True, 2: False, 3: True}
