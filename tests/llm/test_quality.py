import random

import numpy as np
import pytest

from noteloom.llm.quality import BUCKETS, SHARE, CumulativeLink, bucket, features, fit, graded, keep_good, score_quality, shape, train
from noteloom.llm.word_ids import Kept

WORDS = [a + b for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "n r s t l m".split()]


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.randint(20, 120))
        grade = rng.choice([0, 1, 2, 2, 2])
        if grade == 0:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + "###" for w in words]
        elif grade == 1:
            words[rng.randrange(len(words))] = rng.choice(["vile", "nasty", "foul"])
        rows.append((i, " ".join(words), grade))
    return rows


def test_fit_on_held_out_rows():
    kept = Kept()
    rows, held = made(1500, 1), made(500, 2)
    model = fit([features(t, kept) for _, t, _ in rows], np.array([g for _, _, g in rows]))
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails([model.score(*features(t, kept)) for _, t, _ in held])
    assert (np.diff(tails, axis=1) <= 0).all()
    right = np.mean([(p[1] >= 0.6) == (g == 2) for p, (_, _, g) in zip(tails, held)])
    assert right > 0.97
    junk = np.mean([p[0] < 0.5 for p, (_, _, g) in zip(tails, held) if g == 0])
    assert junk > 0.95


def test_gradient_reaches_the_optimum():
    """With one feature and no ridge, the fit matches a fine grid search."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, 400)
    y = np.clip(x + rng.integers(0, 2, 400), 0, 2)
    rows = [(np.array([7, 9]), np.array([v, 0], np.float32)) for v in x]
    model = fit(rows, y, least=1, steps=2000, rate=0.02, ridge=0)

    def loss(w, a, b):
        f = w * x
        c = np.stack([np.zeros(400), 1 / (1 + np.exp(f - a)), 1 / (1 + np.exp(f - b)), np.ones(400)])
        return -np.log(np.maximum(c[y + 1, range(400)] - c[y, range(400)], 1e-12)).mean()

    w, (a, b) = float(model.weights[7]), model.thresholds
    best = loss(w, a, b)
    for dw in (-0.1, 0, 0.1):
        for da in (-0.1, 0, 0.1):
            for db in (-0.1, 0, 0.1):
                assert loss(w + dw, a + da, b + db) >= best - 1e-4


def test_shapes():
    assert [shape(x) for x in ("Word", "WORD!!", "x12-y", "|", "")] == ["Aa", "A!!", "a0-a", "|", ""]


@pytest.fixture
def tables(spark):
    rows = made(600, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "some text", "x"), (700, None, None), (700, "", None), (701, "word " * 20000, None)], "doc_id long, text string, kept string")
    labels = [(i, 0 if g == 0 else 1, int(g == 1)) for i, _, g in rows[:400]] + [(None, 1, 1), (5000, None, 1), (0, None, None), (399, 1, 0)]
    return rows, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_tables(tables):
    rows, docs, labels = tables
    model = train(docs, graded(labels))
    got = score_quality(docs, model).collect()
    assert len(got) == docs.count() and sum(r.doc_id is None for r in got) == 1
    grade = {i: g for i, _, g in rows}
    held = [r for r in got if r.doc_id is not None and 400 <= r.doc_id < 600]
    assert np.mean([r.kept == (grade[r.doc_id] == 2) for r in held]) > 0.9
    assert all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in got)
    kept = keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == sum(r.kept for r in got)
    slow = {r.doc_id: sum(model.tails([model.score(*features(t, Kept()))])[0]) for r, t in [(r, rows[r.doc_id][1]) for r in held[:20]]}
    assert all(abs(slow[r.doc_id] - r.expected_grade) < 1e-9 for r in held[:20])


def test_without_labels(tables):
    _, docs, labels = tables
    assert train(docs, graded(labels.limit(0))) is None
    assert keep_good(docs, labels.limit(0)).count() == docs.count()
    assert keep_good(docs.limit(0), labels).count() == 0
    assert isinstance(CumulativeLink(np.zeros(BUCKETS), np.array([0.0])).tails([0.0])[0][0], float)


def test_rare_words_of_a_grade_get_weights():
    """A word in 12 of 6,000 rows, all of them toxic, rejects a held-out text; the weights it needs don't fall off as the sample grows."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(WORDS, k=40)), 2) for _ in range(5400)] + [(" ".join(rng.choices(WORDS, k=40)) + "!!! ###", 0) for _ in range(500)]
    rows += [(" ".join([*rng.choices(WORDS, k=40), rng.choice(["vile", "nasty", "foul", "bad", "awful"])]), 1) for _ in range(88)]
    rows += [(" ".join([*rng.choices(WORDS, k=40), "bocoos"]), 1) for _ in range(12)]
    kept = Kept()
    model = fit([features(t, kept) for t, _ in rows], np.array([g for _, g in rows]))
    held = [" ".join(rng.choices(WORDS, k=40)) for _ in range(100)]
    top = lambda texts: model.tails([model.score(*features(t, kept)) for t in texts])[:, -1]
    assert np.mean(top([t + " bocoos" for t in held]) < 0.6) > 0.9
    assert np.mean(top(held) >= 0.6) > 0.97


def test_shapes_reach_the_end_of_a_chunk():
    assert shape("x" * 100 + "Y9") == "aA0"
    plain, tailed = (features("a1" * 100 + tail, Kept()) for tail in ("", "#" * 600))
    share = lambda f: dict(zip(f[0].tolist(), f[1].tolist()))
    whole = bucket("shape", "#" * 12)
    assert whole not in share(plain) and share(tailed)[whole] > 0.7 * SHARE
