from collections import defaultdict

from noteloom.llm.exact_dedup import drop_copies, exact_groups


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return groups


def test_groups(odd_docs):
    want = expected((r.doc_id, r.text) for r in odd_docs.collect())
    got = exact_groups(odd_docs, block_bytes=16).collect()
    assert len(got) == odd_docs.count()
    sizes = defaultdict(list)
    for r in got:
        sizes[r.text_sha256].append(r)
    assert sorted(len(v) for v in sizes.values()) == sorted(len(v) for v in want.values())
    for rows in sizes.values():
        assert {r.group_size for r in rows} == {len(rows)} and sum(r.kept for r in rows) == 1
        best = max((r.doc_id for r in rows if r.doc_id is not None), default=None)
        assert {r.keep_id for r in rows} == {best}
        assert [r.doc_id for r in rows if r.kept] == [best]


def test_shifted_blocks_and_shared_parts(spark):
    a, b = "x" * 64, "y" * 64
    texts = [a + b, b + a, a + b, a, a + b + a, a + b + a, a + a, a[:-1], a + b + "z", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keep = {r.doc_id: r.keep_id for r in exact_groups(docs, block_bytes=64).collect()}
    last = {t: i for i, t in enumerate(texts)}
    assert keep == {i: last[t] for i, t in enumerate(texts)}


def test_drop_copies_keeps_columns(odd_docs):
    out = drop_copies(odd_docs)
    assert out.schema == odd_docs.schema
    texts = [r.text or "" for r in out.collect()]
    assert len(texts) == len(set(texts)) == len(expected((r.doc_id, r.text) for r in odd_docs.collect()))
    assert drop_copies(odd_docs.limit(0)).count() == 0
