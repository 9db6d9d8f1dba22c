"""Whitening against a direct eigendecomposition, and the bidiagonal solver against numpy's."""

import numpy as np
import pytest

from quillgraph.llm.bidiagonal import bidiagonalise, right_vectors, squared_singular_values
from quillgraph.llm.whitening import fit_whitening, whiten, whiten_embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2, "x") for i, v in rows], SCHEMA)


def check(rows, got, most=32):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(64 * np.array([v for _, v in kept], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, d = x.shape
    s = x.sum(0)
    dev = ((n * x - s) ** 2).sum(1)
    c = (n * x - s) / n
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()) if e[0] > 0 else 0)
    assert len(got) == n * k
    want_dev = sorted((i if i is not None else -(10**9), int(q)) for (i, _), q in zip(kept, dev))
    assert sorted((r.vec_id if r.vec_id is not None else -(10**9), r.deviation) for r in got if r.component == 1) == want_dev
    if not k:
        return
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    by_id = {i: q for q, (i, _) in enumerate(kept)}
    if len(by_id) == n:
        y = np.zeros((n, k))
        for r in got:
            y[by_id[r.vec_id], r.component - 1] = r.whitened
        assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-8
        for j in range(k):
            if min(abs(e[j] - e[i]) for i in range(d) if i != j) > 1e-4 * e[j]:
                want = c @ v[:, j] / np.sqrt(e[j])
                assert min(np.abs(y[:, j] - want).max(), np.abs(y[:, j] + want).max()) < 1e-6
    for r in got[:200]:
        assert abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-9 * r.explained + 1e-15


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in df.collect()], whiten_embeddings(df.repartition(7)).collect())


def test_awkward_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(40, None), (41, [1, 2, None, 4, 5]), (42, [1, 2, float("nan"), 4, 5]), (43, [1, float("inf"), 2, 3, 4]), (None, [1, 2, 3, 4, 5]), (7, [1, 2, 3, 4, 5])]
    got = whiten_embeddings(table(spark, rows)).collect()
    check(rows, got)
    assert whiten_embeddings(table(spark, rows)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ragged = whiten_embeddings(table(spark, [*rows, (50, []), (51, [1.0]), (52, [1e30] * 5)])).collect()
    check(rows, ragged)  # empty, odd and huge ones are dropped


def test_no_variance(spark):
    for rows in ([], [(1, None)], [(1, [1, 2, 3])], [(1, [1, 2, 3]), (2, [1, 2, 3])], [(1, [])]):
        assert whiten_embeddings(table(spark, rows)).collect() == []


def test_dependent_dimensions(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(60):
        a, b = rng.normal(size=2)
        rows.append((i, [a, a, b, 3.0, b, a]))
    check(rows, whiten_embeddings(table(spark, rows)).collect())


def test_a_hot_vector_and_many_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [5.0, -3.0, 0.25, 9.0] if i % 3 else rng.normal(size=4).tolist()) for i in range(300)]
    check(rows, whiten_embeddings(table(spark, rows).repartition(90)).collect())


def test_deviation_beyond_a_long(spark):
    rows = [(i, [2.0**40 * (i % 2), float(i)]) for i in range(8)]
    m = fit_whitening(table(spark, rows))
    got = {r.vec_id: r.deviation for r in whiten(table(spark, rows), m).collect()}
    assert set(got.values()) == {None} and len(got) == 8


@pytest.mark.parametrize("kind", ["random", "graded", "clustered", "identity", "zeros"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 40))
    if kind == "graded":
        x = x * np.logspace(0, -9, 40)
    if kind == "clustered":
        x = np.linalg.qr(x)[0] * np.repeat([3.0, 2.0, 1.0, 0.5], 10) * (1 + 1e-9 * rng.normal(size=40))
    if kind == "identity":
        x = np.vstack([np.eye(40)] * 3)
    if kind == "zeros":
        x[:, 10:] = 0
    r = np.linalg.qr(x)[1]
    a, b, v = bidiagonalise(r)
    want = np.linalg.svd(x, compute_uv=False) ** 2
    got = squared_singular_values(a, b)
    assert len(got) == 40 and np.abs(got - want).max() < 1e-12 * want[0]
    if kind == "graded":
        assert np.abs(got / want - 1).max() < 1e-9
    e, z = right_vectors(a, b, 32)
    w = v @ z
    assert np.abs(w.T @ w - np.eye(32)).max() < 1e-10 and np.abs(x.T @ (x @ w) - w * e).max() < 1e-11 * want[0]
