"""The pipeline's stages against brute force, on a small made-up table."""

import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from noteloom.llm.queries import tokenizer_path
from noteloom.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [a + b for a in "ba be bi bo ka ke ki ko ma me mi mo".split() for b in "n r s t l".split()]
    texts, grades = [], []
    for _ in range(240):
        t = rng.choices(words, k=rng.randint(30, 150))
        junk = rng.random() < 0.3
        texts.append(" ".join(w.upper() + "!!" if junk else w for w in t))
        grades.append(int(not junk))
    for i in range(0, 60, 3):
        texts.append(texts[i])
        grades.append(grades[i])
        texts.append(texts[i] + " x")
        grades.append(grades[i])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None), (900, None, "en", "s", 0)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in enumerate(grades) if i % 2 == 0], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.schema
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.schema == columns
        steps[name] = docs.collect()
    good = [r for r in steps["quality"] if r.text]
    assert len(good) > 150 and not any("!!" in r.text for r in good)
    last = {}
    for r in steps["quality"]:
        last[r.text or ""] = max(last.get(r.text or "", -1), r.doc_id)
    assert sorted((r.text or "", r.doc_id) for r in steps["exact"]) == sorted(last.items())
    prints = {r.doc_id: fingerprint(r.text) for r in steps["exact"]}
    group = {d: d for d in prints}
    for a in sorted(prints):
        for b in sorted(prints):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert sorted(r.doc_id for r in steps["near"]) == sorted(set(group.values()))
    byte = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = {r.doc_id: len(byte.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in steps["near"]}
    got, used = defaultdict(int), defaultdict(int)
    for r in steps["pack"]:
        got[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert got == want and max(used.values()) <= 1024
    assert np.mean([n == 1024 or n & (n - 1) == 0 for n in used.values()]) == 1


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
