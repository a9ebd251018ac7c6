import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noteloom.llm.packing import Packer, pack_texts
from noteloom.llm.rank_bpe import RankBPE, encode_decode, merge_heap, merge_scan
from noteloom.llm.token_files import read_token_files, write_token_files
from noteloom.llm.word_ids import Kept, cut_before_spaces, cut_lowered, keyed_ids, library_encoder

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
bpe = RankBPE(open(WORD, encoding="utf-8").read())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcdTHE.,<|>\x85 ΣİéǺ <|endoftext|>"), st.characters(codec="utf-8", max_codepoint=0x2FFF)), max_size=60))
def test_same_ids_as_the_library(text):
    ids = ids_of(word, text)
    assert bpe.encode(text) == ids
    assert bpe.decode(ids) == word.decode(ids, skip_special_tokens=False)


encode_chunks = library_encoder(open(WORD, encoding="utf-8").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tabTHE.,<|>\x85 ΣİéǺ"), st.characters(codec="utf-8", max_codepoint=0x3FF)), max_size=40), max_size=4))
def test_chunks_keep_ids_of_whole_texts(texts):
    assert keyed_ids(texts, cut_lowered, encode_chunks, Kept()) == [np.array(ids_of(word, t), "<u4").tobytes() for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t'abcdTHE.,12<|>\x1c\x85 é "), max_size=40))
def test_chunks_before_spaces_keep_ids(text):
    assert [i for c in cut_before_spaces(text) for i in ids_of(byte, c)] == ids_of(byte, text)


@given(st.text(alphabet="abth", min_size=1, max_size=30))
def test_scan_and_heap_agree(text):
    parts = [bpe.vocab[c] for c in [*text[:-1], text[-1] + "</w>"]]
    assert merge_scan(list(parts), bpe.pairs) == merge_heap(list(parts), bpe.pairs)


def test_encode_decode(odd_docs):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in encode_decode(odd_docs, WORD).collect())
    want = Counter()
    for r in odd_docs.collect():
        ids = ids_of(word, r.text)
        decoded = word.decode(ids, skip_special_tokens=False)
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded)] += 1
    assert got == want
    assert encode_decode(odd_docs.limit(0), WORD, full=False).collect() == []


def test_token_files_round_trip(spark, odd_docs, tmp_path):
    manifest = write_token_files(odd_docs, str(tmp_path / "t"), WORD)
    rows = read_token_files(spark, str(tmp_path / "t"), with_ids=True).collect()
    rows.sort(key=lambda r: r.start)
    ids = [r.doc_id if r.doc_id is not None else -1 for r in rows]
    assert ids == sorted(ids) and len(rows) == odd_docs.count()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert at == manifest["total"]
    got = Counter((r.doc_id, bytes(r.ids), r.ids_crc32, r.n_tokens) for r in rows)
    want = Counter()
    for r in odd_docs.collect():
        raw = np.array([*ids_of(word, r.text), 2], "<u4").tobytes()
        want[(r.doc_id, raw, zlib.crc32(raw), len(raw) // 4)] += 1
    assert got == want
    empty = write_token_files(odd_docs.limit(0), str(tmp_path / "e"), WORD)
    assert empty["total"] == 0 and read_token_files(spark, str(tmp_path / "e"), empty).count() == 0


def padding(lengths):
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths)


def test_pack_texts(odd_docs):
    rows = pack_texts(odd_docs, BYTE, with_ids=True).collect()
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and r.length * 4 == len(r.ids) and r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, bytes(r.ids)))
    lengths = []
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
        lengths.append(at)
    assert padding(lengths) == 0
    total = 0
    for r in odd_docs.collect():
        raw = np.array([*ids_of(byte, r.text), 0], "<u4").tobytes()
        total += len(raw)
        if r.doc_id not in (3, None):
            joined, at = b"", 0
            for start, length, ids in sorted(pieces[r.doc_id, len(raw) // 4]):
                assert start == at
                joined, at = joined + ids, at + length
            assert joined == raw
    assert total == sum(len(r.ids) for r in rows)
    assert pack_texts(odd_docs.limit(0), BYTE).collect() == []


def test_packer_keeps_all_limits():
    rng = np.random.default_rng(1)
    packer = Packer(tokens=100, segments=4, loss=50, cut=False, window=16)
    sizes = {i: (int(t), int(rng.integers(0, t + 1))) for i, t in enumerate(rng.integers(1, 70, 400))}
    sizes = {i: (t, min(loss, 50)) for i, (t, loss) in sizes.items()}
    out = [x for i, (t, loss) in sizes.items() for x in packer.add(i, t, loss)] + list(packer.finish())
    seen = []
    for _, pieces in out:
        items = [i for i, _, _, _ in pieces]
        seen += items
        assert len(items) <= 4 and sum(sizes[i][0] for i in items) <= 100 and sum(sizes[i][1] for i in items) <= 50
    assert sorted(seen) == list(range(400))
    assert len({s for s, _ in out}) == len(out)


def test_kept_is_bounded():
    kept = Kept(100)
    for i in range(1000):
        kept.put(i, i)
    assert len(kept.new) + len(kept.old) <= 100 and kept.get(999) == 999 and kept.get(0) is None


@pytest.mark.parametrize("text", ["a" * 5000, "xyz" * 3000])
def test_long_words(text):
    assert bpe.encode(text) == ids_of(word, text)
