"""Problem 4 against brute force."""

import numpy as np
import pytest

from thicket.llm import curves as C


def test_hilbert_visits_neighbours():
    n, bits = 3, 3
    grid = np.array(np.meshgrid(*[range(1 << bits)] * n)).reshape(n, -1).T
    key = C.hilbert(grid, bits)
    assert sorted(key) == list(range(1 << (n * bits)))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def vectors(seed=1, n=1500, size=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size))
    near = [base[i] + rng.standard_normal(size) * s for i in range(0, n, 5) for s in rng.choice([0.1, 0.2, 0.3], rng.integers(0, 5))]
    x = np.vstack([base, near])
    x *= rng.uniform(0.2, 3, (len(x), 1))
    x[40] = x[41] = x[42]
    return x.astype(np.float32)


def brute(x, ids, k=10, least=0.9):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    np.fill_diagonal(c, -2)
    kth = -np.sort(-c, axis=1)[:, k - 1]
    a, b = np.nonzero((c >= least) & (c >= kth[:, None]) & (c >= kth[None, :]))
    return {(int(ids[i]), int(ids[j])) for i, j in zip(a, b) if ids[i] < ids[j]}


def test_mutual_neighbours(spark):
    x = vectors()
    ids = np.arange(len(x)) * 3 + 1
    df = spark.createDataFrame([(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x)], "id long, embedding array<float>, copies int").repartition(7)
    got = {tuple(r) for r in C.mutual(C.close_vectors(df, "id", "embedding")).collect()}
    want = brute(x, ids)
    assert got <= want | got and len(got & want) >= 0.99 * len(want) > 200 and len(got - want) <= 0.01 * len(want)


def test_more_copies_than_a_window(spark):
    """A vector stored 300 times, and one near it: every pair ties or is beaten by the copies."""
    rng = np.random.default_rng(4)
    v, others = rng.standard_normal(64), rng.standard_normal((200, 64))
    x = np.vstack([np.repeat(v[None], 300, 0), v + 0.05 * rng.standard_normal(64), others])
    df = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "id long, v array<double>")
    got = {tuple(r) for r in C.mutual(C.close_vectors(df, "id", "v")).collect()}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300)}


def test_cluster_of_distinct_vectors(spark, monkeypatch):
    """2,000 distinct vectors of mean cosine 0.95 overflow every window; no pair may be missing or wrong."""
    rng = np.random.default_rng(12)
    x = np.vstack([rng.standard_normal(64) + 0.23 * rng.standard_normal((2000, 64)), rng.standard_normal((1000, 64))]).astype(np.float32)
    monkeypatch.setattr(C, "BLOCK", 1000)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>")
    got = {tuple(r) for r in C.mutual(C.close_vectors(df, "id", "v")).collect()}
    assert got == brute(x, np.arange(len(x))) and len(got) > 1000


def test_edges(spark):
    a = [1.0] + [0.0] * 63
    b = [2.0, 0.1] + [0.0] * 62
    rows = [(1, a), (2, b), (3, None), (4, []), (5, a[:32]), (6, [0.0] * 64), (7, [None] + a[1:]), (8, [float("nan")] + a[1:]), (None, a), (9, [float("inf")] + a[1:]), (1, a)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [tuple(r) for r in C.mutual(C.close_vectors(df, "id", "v")).collect()] == [(1, 2)]
    assert C.mutual(C.close_vectors(df.where("false"), "id", "v")).count() == 0
    with pytest.raises(Exception):
        C.close_vectors(df, "id", "no such column")
