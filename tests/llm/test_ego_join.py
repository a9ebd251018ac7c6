import numpy as np
import pytest

from noteloom.llm import ego_join
from noteloom.llm.ego_join import vector_links


def slow(rows):
    ok = []
    for i, (_, v) in enumerate(rows):
        fine = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if fine else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and ok[i] is not None and ok[j] is not None and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.9 - 1e-12] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return sorted(map(str, out))


@pytest.fixture
def vectors():
    rng = np.random.default_rng(0)
    rows = []
    for c in rng.normal(size=(60, 12)):
        for _ in range(rng.integers(1, 9)):
            rows.append((c + rng.normal(size=12) * rng.choice([0.05, 0.15, 0.3])).astype(np.float32).tolist())
    rows += [rows[0]] * 40 + [[2 * x for x in rows[1]]] * 3
    rows += [None, [], [0.0] * 12, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1.0, 0.0], [1.0, 0.1], [1e-30] * 12, [3e38] * 12]
    return [(i, v) for i, v in enumerate(rows)] + [(None, rows[0]), (5, rows[5]), (5, rows[5])]


@pytest.mark.parametrize("cut", [False, True])
def test_against_all_pairs(spark, vectors, cut, monkeypatch):
    if cut:
        monkeypatch.setattr(ego_join, "math", type("m", (), {"sqrt": lambda x: __import__("math").sqrt(x) * (8 if x > 50 else 1), "fsum": __import__("math").fsum}))
    table = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    got = vector_links(table).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == slow(vectors)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty(spark):
    assert vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
