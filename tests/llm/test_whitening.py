import numpy as np
import pytest

from marginalia.llm import whitening as W
from marginalia.llm.queries import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, `a.b` string, vector int"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, "x", 0) for k, v in enumerate(vectors)], SCHEMA)


def brute(vectors, components=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    kept = min(components, int((values > 1e-12 * values[0]).sum()))
    y = centred @ vectors_[:, :kept] / np.sqrt(values[:kept])
    return n, ((n * x - sums) ** 2).sum(axis=1), y, values[:kept] / values.sum()


def check(rows, vectors):
    n, deviation, y, explained = brute(vectors)
    assert len(rows) == y.size
    got = np.zeros_like(y)
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-8
    signs = np.sign((got * y).sum(axis=0))
    assert np.allclose(got * signs, y, atol=1e-6)


def test_query_equals_eigenvectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FAN_IN", 2)
    monkeypatch.setattr(W, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(120, 40)) * np.linspace(3, 0.5, 40)).astype(np.float32).tolist()
    frame(spark, vectors).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(op12_whitening(spark, str(tmp_path)).collect(), vectors)


def test_odd_vectors_are_left_out(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(30, 3)).astype(np.float32).tolist()
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0, 2.0]]
    check(W.whitened_components(frame(spark, good + odd)).collect(), good)


def test_without_variance(spark):
    assert W.whitened_components(frame(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert W.whitened_components(frame(spark, [None, []])).count() == 0
    assert W.whitened_components(frame(spark, [[1.0, 2.0]]).where("vec_id < 0")).count() == 0
    line = [[float(k), 2.0 * k, 7.0] for k in range(9)]
    assert {r.component for r in W.whitened_components(frame(spark, line * 2)).collect()} == {1}


def test_deviations_beyond_64_bits(spark):
    vectors = [[1e9, 0.0], [-1e9, 1.0], [0.0, 2.0]] * 2000
    rows = W.whitened_components(frame(spark, vectors)).collect()
    x = [[int(64 * c) + 1_000_000 for c in np.float32(v).astype(float)] for v in vectors]
    sums, n = [sum(c) for c in zip(*x, strict=True)], len(x)
    for r in rows[::999]:
        exact = sum((n * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))
        assert r.deviation == (exact if exact < 2**63 else None)


@pytest.mark.parametrize("kind", ["random", "graded", "near", "equal", "diagonal", "low", "one"])
def test_solver(kind):
    rng = np.random.default_rng(5)
    q = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    matrix = {
        "random": rng.normal(size=(50, 50)),
        "graded": rng.normal(size=(50, 50)) * np.logspace(0, -5, 50),
        "near": q(40) @ np.diag([3 + 1e-9 * k for k in range(20)] + [1 + 1e-13 * k for k in range(20)]) @ q(40),
        "equal": np.eye(12) * 2,
        "diagonal": np.diag([1.0, 2, 3, 3, 0, 5]),
        "low": np.outer(rng.normal(size=20), rng.normal(size=20)),
        "one": np.array([[2.0]]),
    }[kind]
    triangle = np.linalg.qr(matrix, mode="r")
    squares, vectors = W.principal(triangle)
    true = np.linalg.svd(triangle, compute_uv=False) ** 2
    kept = int((true > 1e-12 * true[0]).sum())
    assert np.allclose(squares, true, rtol=1e-10, atol=1e-13 * true[0])
    v = vectors[:, :kept]
    assert np.abs(v.T @ v - np.eye(kept)).max() < 1e-11
    assert np.abs(triangle.T @ (triangle @ v) - v * squares[:kept]).max() < 1e-12 * true[0]


def test_singular_values_have_relative_accuracy():
    """A graded bidiagonal matrix, whose least value is far below the rounding of the greatest."""
    diagonal, upper = 10.0 ** -np.arange(0, 24, 2.0), 10.0 ** -(np.arange(1, 23, 2.0) + 3)
    squares = W.squared_singular_values(diagonal, upper)
    assert np.prod(squares / diagonal**2) == pytest.approx(1.0, rel=1e-12)
    assert (squares > 0).all()
