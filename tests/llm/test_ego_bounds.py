"""What the bounds skip, and pairs at the very limit."""

from fractions import Fraction

import numpy as np
import pytest

from noteloom.llm.ego_join import COSINE, LEADING, Stretch, ego_pairs, linked, principal, unit, vector_links

EPS = (2 - 2 * COSINE) ** 0.5


def all_pairs(raw):
    x = unit(raw)
    dots = x @ x.T
    i, j = np.nonzero(np.triu(dots >= COSINE - 1e-9, 1))
    return {(a, b) for a, b in zip(i.tolist(), j.tolist()) if dots[a, b] > COSINE + 1e-9 or linked(raw[a], raw[b], COSINE)}


def pairs_of(s, t, seen, shift=0):
    return {(min(a, b + shift), max(a, b + shift)) for x, y in ego_pairs(s, t, EPS, COSINE, few=32, seen=seen) for a, b in zip(x.tolist(), y.tolist())}


def clustered(rng, clusters, each, width, spread):
    centres = rng.normal(size=(clusters, width))
    raw = np.repeat(centres / np.linalg.norm(centres, axis=1, keepdims=True), each, 0) + rng.normal(size=(clusters * each, width)) * spread / width**0.5
    return raw[rng.permutation(len(raw))].astype("<f4")


@pytest.mark.parametrize(("width", "spread", "skipped"), [(16, 0.1, 0.85), (64, 0.15, 0.8), (64, 0.4, 0.25)])
def test_clusters_are_skipped(width, spread, skipped):
    raw = clustered(np.random.default_rng(width), 60, 50, width, spread)
    basis = principal(unit(raw), LEADING)
    seen = {}
    whole = Stretch(raw, basis, EPS)
    assert pairs_of(whole, whole, seen) == all_pairs(raw)
    assert seen["compared"] < (1 - skipped) * seen["all"], seen
    a, b = Stretch(raw[:1400], basis, EPS), Stretch(raw[1400:], basis, EPS)
    assert pairs_of(a, a, {}) | pairs_of(b, b, {}) | pairs_of(a, b, {}, 1400) | {(p + 1400, q + 1400) for p, q in pairs_of(b, b, {})} >= all_pairs(raw)


def test_random_directions_are_not():
    """All random directions in 64 dimensions are about as far apart, so nothing can be proved of stretches of them."""
    raw = np.random.default_rng(1).normal(size=(1500, 64)).astype("<f4")
    raw[:40] = raw[40:80] + np.random.default_rng(2).normal(size=(40, 64)).astype("<f4") * 0.05
    seen = {}
    whole = Stretch(raw, principal(unit(raw), LEADING), EPS)
    assert pairs_of(whole, whole, seen) == all_pairs(raw) and len(all_pairs(raw)) == 40
    assert seen["compared"] == seen["all"]


def test_no_pair_below_the_limit(spark):
    """Pairs whose cosine lies within rounding of 0.9 are told apart exactly."""
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for i in range(150):
        turned = np.linalg.qr(rng.normal(size=(4, 4)))[0][:2]
        angle = np.arccos(0.9) + rng.integers(-3, 4) * 1.2e-16
        a, b = (200 + i) * turned[0], np.cos(angle) * turned[0] + np.sin(angle) * turned[1]
        v = [np.concatenate([np.zeros(4 * (i % 30)), z, np.zeros(4 * (29 - i % 30))]) + 0.0 for z in (a, b)]
        v[0][-1] += 1e-9 * i
        rows += [(2 * i, v[0].tolist()), (2 * i + 1, v[1].tolist())]
    n = np.array([v for _, v in rows])
    x = unit(n)
    near = np.argwhere(np.triu(x @ x.T >= 0.9 - 1e-6, 1)).tolist()
    exact = lambda p, q: (lambda d, e, f: d > 0 and d * d >= Fraction(0.9) ** 2 * e * f)(*(sum(Fraction(s) * Fraction(t) for s, t in zip(g, h)) for g, h in ((p, q), (p, p), (q, q))))
    for p, q in near:
        if exact(rows[p][1], rows[q][1]):
            want[p] = want.get(p, 0) + 1
            want[q] = want.get(q, 0) + 1
    got = {r.vec_id: r.n_links for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: want.get(i, 0) for i, _ in rows}
    assert 20 < sum(want.values()) < 2 * len(near)


def test_many_intervals(spark):
    raw = clustered(np.random.default_rng(9), 80, 20, 12, 0.2)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(raw)]
    pairs = all_pairs(raw)
    got = {r.vec_id: r.n_links for r in vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string"), largest=100).collect()}
    assert got == {i: sum(i in p for p in pairs) for i in range(len(rows))}
