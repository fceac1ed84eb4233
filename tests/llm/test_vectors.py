"""p1: nearest neighbours against brute force."""

import numpy as np

from engramlake.llm import neighbours as N

SCHEMA = "id string, embedding array<float>, rep string, unit int"


def brute(vectors, k, least):
    ids = sorted(vectors)
    v = np.array([vectors[i] for i in ids], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    out = set()
    for r, i in enumerate(ids):
        s[r, r] = -2
        near = np.flatnonzero(s[r] >= least)
        near = near[np.lexsort((near, -s[r][near]))][:k]
        out |= {tuple(sorted((i, ids[j]))) for j in near}
    return out


def clustered(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(1, n // 8), dim))
    x = centres[r.integers(0, len(centres), n)] + 0.35 * r.standard_normal((n, dim))
    return {f"n{i:05d}": (x[i] * r.uniform(0.1, 9)).astype(np.float32).astype(float).tolist() for i in range(n)}


def pairs(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.neuron_a, r.neuron_b) for r in N.neighbour_pairs(df, **options).collect()}


def test_small_inputs_are_exact(spark):
    v = clustered(500, 16, 1)
    assert pairs(spark, [(i, x, "a", 1) for i, x in v.items()], dim=16) == brute(v, 5, 0.85)


def test_recall_with_many_cells(spark):
    v = clustered(14_000, 32, 2)
    want, got = brute(v, 5, 0.85), pairs(spark, [(i, x, "a", 1) for i, x in v.items()], dim=32)
    assert len(want & got) >= 0.97 * len(want)
    assert len(got - want) <= 0.02 * len(want)


def test_recall_with_centroids_of_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "FITTED", 64)
    monkeypatch.setattr(N, "PER_CELL", 30)
    v = clustered(6000, 24, 5)
    assert len(N.fit_centroids(N._matrix(__import__("pyarrow").array([np.array(x).tobytes() for x in v.values()]), 24), 200)) in range(150, 260)
    want, got = brute(v, 5, 0.85), pairs(spark, [(i, x, "a", 1) for i, x in v.items()], dim=24)
    assert len(want & got) >= 0.95 * len(want)


def test_hot_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "DATA_BLOCK", 40)
    monkeypatch.setattr(N, "QUERY_RUN", 60)
    v = clustered(400, 16, 3)
    assert pairs(spark, [(i, x, "a", 1) for i, x in v.items()], dim=16) == brute(v, 5, 0.85)


def test_odd_vectors_copies_and_ties(spark):
    one, nan = [1.0, 0.0, 0.0, 0.0], float("nan")
    rows = [(f"c{i}", one, None, None) for i in range(9)] + [("c0", one, None, None)]  # copies tie at 1, smaller ids first
    rows += [("x", None, None, None), ("y", [], None, None), ("z", [0.0] * 4, None, None), ("w", [nan, 1.0, 0.0, 0.0], None, None), ("v", [1.0, 2.0], None, None), (None, one, None, None), ("u", [None, 1.0, 0.0, 0.0], None, None)]
    got = pairs(spark, rows, dim=4)
    want = {tuple(sorted((f"c{i}", o))) for i in range(9) for o in [f"c{j}" for j in range(9) if j != i][:5]}
    assert got == want
    assert pairs(spark, [], dim=4) == set()


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(0)
    x = r.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, d, cos = N.Codes(x).search(x[:50], 0.3, 2000)
    exact = x[:50] @ x.T
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(exact >= 0.3))}
    assert len(set(zip(q.tolist(), d.tolist())) & want) >= 0.97 * len(want)
    assert np.allclose(cos, exact[q, d])
