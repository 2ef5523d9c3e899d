import math

import numpy as np

from penfit.operators import generate as gen
from penfit.operators.linalg import vector_np


def _mat(df):
    pdf = df.toPandas().sort_values("row_id")
    return np.stack(pdf["features"].to_numpy())


def test_gaussian_same_under_any_partitioning(spark):
    a = _mat(gen.gaussian_design(spark, 200, 7, partitions=3))
    b = _mat(gen.gaussian_design(spark, 200, 7, partitions=11))
    np.testing.assert_array_equal(a, b)
    assert abs(a.mean()) < 0.2 and abs(a.std() - 1) < 0.1


def test_sparse_weights(spark):
    w1 = vector_np(gen.sparse_weights(spark, 95), 95, "weight")
    w2 = vector_np(gen.sparse_weights(spark, 95), 95, "weight")
    np.testing.assert_array_equal(w1, w2)
    assert (w1 != 0).sum() == 95 // 10


def test_make_lasso_data(spark):
    design, lam, wt, normed = gen.make_lasso_data(spark, 400, 30, partitions=4)
    pdf = design.toPandas().sort_values("row_id")
    A = np.stack(pdf["features"].to_numpy())
    b = pdf["label"].to_numpy()
    normed.unpersist()
    np.testing.assert_allclose(np.linalg.norm(A, axis=0), 1.0, rtol=1e-12)
    w = vector_np(wt, 30, "weight")
    b0 = A @ w
    sigma = math.sqrt(b0 @ b0 / 30) * 10 ** -1.5
    assert abs(lam - 2 * sigma * math.sqrt(2 * math.log(30))) < 1e-9 * lam
    noise = b - b0
    term = math.sqrt(np.mean(b0 ** 2)) * 10 ** -1.5
    assert 0.7 < noise.std() / term < 1.3
    # noise is not one sequence repeated per partition
    quarters = noise.reshape(4, 100)
    assert not np.allclose(quarters[0], quarters[1])


def test_read_or_make_lasso(spark, tmp_dir):
    import os
    dpath, ppath = os.path.join(tmp_dir, "design"), os.path.join(tmp_dir, "lambda")
    d1, lam1 = gen.read_or_make_lasso(spark, dpath, ppath, 120, 20, partitions=3)
    d2, lam2 = gen.read_or_make_lasso(spark, dpath, ppath, 999, 999)   # read, not regenerated
    assert lam1 == lam2 and d1.count() == d2.count() == 120
    rows = d2.toPandas().sort_values("row_id")
    assert len(rows["features"].iloc[0]) == 20
