import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from noteloom.llm.quality import BUCKETS, CumulativeLink, bucket, chunk_buckets, features, shapes
from noteloom.llm.word_ids import Kept, chunked, cut_words

MODEL = CumulativeLink(np.random.default_rng(0).normal(size=BUCKETS).astype(np.float32) * (np.random.default_rng(1).random(BUCKETS) < 0.5), np.array([0.0, 1.0]))
PARTS = st.one_of(st.sampled_from([*"  \n\taAbB9.,!?\x01\x1c\x85\xa0　İǅßé²", "Word", "word", "WORD!!", "don't", " word word "]), st.characters(codec="utf-8", max_codepoint=0x2FFF))
KEPT = Kept(most_bytes=1 << 14, weigh=lambda values: (200 for _ in values))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PARTS, max_size=30).map("".join)), max_size=8))
def test_many_texts_score_as_each_does(texts):
    got = MODEL.scores(texts, KEPT)
    assert len(got) == len(texts)
    for x, t in zip(got, texts):
        assert abs(x - MODEL.score(*features(t, Kept()))) < 1e-9


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=6).map("".join))
def test_shapes_of_plain_chunks(chunk):
    assert chunk_buckets(chunk)[1] == tuple(bucket("shape", s) for s in shapes(chunk))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=20).map("".join), max_size=5))
def test_words_are_cut_as_python_does(texts):
    codes, ends, chunks = chunked(texts, cut_words)
    names = chunks.to_pylist()
    assert [[names[c] for c in codes[a:b] if names[c]] for a, b in zip([0, *ends], ends)] == [t.split() for t in texts]
