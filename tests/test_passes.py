import numpy as np
import pytest

from conftest import make_design
from penfit.operators import passes


def test_multi_pass_matches_numpy(spark, small_problem):
    A, b = small_problem
    d = make_design(spark, A, b, partitions=4)
    V = np.random.default_rng(1).standard_normal((12, 3))
    r = passes.multi_pass(d, 12, V, [True, False, True], [0, 2])
    R = A @ V - np.outer(b, [1.0, 0.0, 1.0])
    assert r.n == 300
    np.testing.assert_allclose(r.cross, R.T @ R, rtol=1e-12, atol=1e-9)
    np.testing.assert_allclose(r.losses, 0.5 * (R * R).sum(0), rtol=1e-12)
    np.testing.assert_allclose(r.grads, A.T @ R[:, [0, 2]], rtol=1e-12, atol=1e-9)


def test_block_aggregation_path(spark, small_problem, monkeypatch):
    """The Spark-side block sum gives the same as the driver-side merge."""
    A, b = small_problem
    d = make_design(spark, A, b, partitions=5)
    V = np.ones((12, 1))
    monkeypatch.setattr(passes, "BLOCK", 7)
    r1 = passes.multi_pass(d, 12, V, [True], [0], tasks=None)
    r2 = passes.multi_pass(d, 12, V, [True], [0], tasks=5)
    np.testing.assert_allclose(r1.grads, r2.grads, rtol=1e-12)
    np.testing.assert_allclose(r1.losses, r2.losses, rtol=1e-12)


def test_gram_pass(spark, small_problem):
    A, b = small_problem
    g = passes.gram_pass(make_design(spark, A, b), 12)
    np.testing.assert_allclose(g.G, A.T @ A, rtol=1e-12, atol=1e-10)
    np.testing.assert_allclose(g.c, A.T @ b, rtol=1e-12, atol=1e-10)
    assert g.n == 300 and abs(g.bb - b @ b) < 1e-8


def test_predict_and_sumsq(spark, small_problem):
    A, b = small_problem
    d = make_design(spark, A, b)
    w = np.arange(12.0)
    out = passes.predict(d, w).toPandas().sort_values("row_id")
    np.testing.assert_allclose(out["prediction"].to_numpy(), A @ w, rtol=1e-12)


def test_more_tasks_than_rows(spark):
    A = np.array([[1.0, 2.0], [3.0, 4.0]])
    b = np.array([1.0, 2.0])
    d = make_design(spark, A, b, partitions=9)
    r = passes.multi_pass(d, 2, np.ones((2, 1)), [True], [0], tasks=9)
    assert r.n == 2
    np.testing.assert_allclose(r.grads[:, 0], A.T @ (A @ np.ones(2) - b))


def test_unequal_lengths_fail(spark):
    df = spark.createDataFrame([(0, 1.0, [1.0, 2.0]), (1, 2.0, [1.0])],
                               "row_id bigint, label double, features array<double>")
    with pytest.raises(Exception):
        passes.multi_pass(df, 2, np.ones((2, 1)), [True], [0])
