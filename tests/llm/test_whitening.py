"""Whitening against a library decomposition of the plain covariance."""

import numpy as np
import pytest

from tickloom.llm.catalog import QUERIES
from tickloom.llm.whitening import decomposition, whiten

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("kind", ["random", "repeated", "rounded copies", "graded", "one", "zero", "orthogonal", "wide gaps"])
def test_decomposition_equals_the_library(kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 24))
    r = {"random": x, "repeated": np.hstack([x[:, :10]] * 2), "rounded copies": np.hstack([x[:, :10], x[:, :10] * (1 + 1e-15)]), "graded": x * 10.0 ** -np.arange(24),
         "one": x[:, :1], "zero": np.zeros((9, 9)), "orthogonal": np.linalg.qr(x)[0], "wide gaps": x * np.repeat([1e6, 1.0, 1e-4], 8)}[kind]
    r = np.linalg.qr(r, "r")
    values, vectors = decomposition(r)
    true = np.linalg.svd(r, compute_uv=False) ** 2
    scale = max(true[0], 1e-300)
    assert np.abs(values - true).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(r))).max() < 1e-11
    assert np.abs(r.T @ r @ vectors - vectors * values).max() <= 1e-13 * scale


def expected(rows, k=32):
    """vec_id -> deviation and components up to sign, from the covariance of the quantised rows."""
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    far = n * x.astype(object) - sums.astype(object)
    centred = far.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, (far * far).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def test_query_equals_the_library(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    n, deviation, whitened, explained = expected(rows)
    found = {(r.vec_id, r.component): r for r in QUERIES["op13_whitening"](spark, SF).collect()}
    assert len(found) == 32 * len(rows)
    own = np.array([[found[i, c].whitened for c in range(1, 33)] for i, _ in rows])
    assert np.abs(np.abs(own) - np.abs(whitened)).max() < 1e-8
    assert np.abs(own.T @ own / n - np.eye(32)).max() < 1e-9
    for (i, _), d in zip(rows, deviation, strict=True):
        assert found[i, 1].deviation == d and found[i, 1].n == n and 0 <= found[i, 1].identity_error < 1e-9
        assert [found[i, c].explained for c in range(1, 33)] == pytest.approx(list(explained), rel=1e-9)


def test_awkward_embeddings(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist(), "x", 1) for i in range(40)] + [(7, [0.5, 0.25, -1.0], "x", 1)] * 3 + [(None, [1.0, 2.0, 3.0], None, None)]
    bad = [(90, None, "n", 0), (91, [1.0, None, 2.0], "n", 0), (92, [float("nan"), 1.0, 2.0], "n", 0), (93, [float("inf"), 1.0, 2.0], "n", 0), (94, [], "n", 0)]
    other = [(200, [1.0, 2.0], "l", 2), (201, [2.0, 4.0], "l", 2), (300, [1.0], "one", 3)]
    df = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<double>, component string, n int")
    out = whiten(df).collect()
    at = {}
    for r in out:
        at.setdefault(r.vec_id, []).append(r)
    assert not {90, 91, 92, 93, 94, 300} & set(at)
    assert len(at[7]) == 4 * 3 and len(at[None]) == 3 and all(r.n == 44 for r in at[None])
    assert [(r.component, r.n, r.explained) for r in at[200]] == [(1, 2, 1.0)] and {r.whitened for r in at[200] + at[201]} == {1.0, -1.0}
    n, deviation, whitened, _ = expected([(i, v) for i, v, *_ in rows])
    own = sorted((str(r.vec_id), r.deviation, abs(r.whitened)) for r in out if r.component == 1 and r.n == n)
    assert own == [(i, d, pytest.approx(w)) for i, d, w in sorted((str(r[0]), d, abs(w[0])) for r, d, w in zip(rows, deviation, whitened, strict=True))]
    assert whiten(df.limit(0)).collect() == []
    big = spark.createDataFrame([(1, [1e300]), (2, [-1e300])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whiten(big).collect()} == {None}
