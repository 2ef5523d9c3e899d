import math

import numpy as np

from conftest import make_design
from penfit.functions import columns as cols
from penfit.operators import linalg


def _arr(df, col="features"):
    pdf = df.toPandas().sort_values("row_id")
    return np.stack(pdf[col].to_numpy()) if col == "features" else pdf[col].to_numpy()


def test_norms_and_normalize_both_paths(spark, small_problem, monkeypatch):
    A, b = small_problem
    A = A.copy()
    A[:, 3] = 0.0
    d = make_design(spark, A, b)
    norms = linalg.vector_np(linalg.column_norms(d), 12, "norm")
    np.testing.assert_allclose(norms, np.linalg.norm(A, axis=0), rtol=1e-12)
    expect = np.where(norms != 0, A / np.where(norms != 0, norms, 1), 0.0)
    np.testing.assert_allclose(_arr(linalg.normalize_columns(d)), expect, rtol=1e-12)
    monkeypatch.setattr(linalg, "MAX_LITERAL_ARRAY", 4)   # force the Arrow path
    np.testing.assert_allclose(_arr(linalg.normalize_columns(d, norms)), expect, rtol=1e-12)


def test_predict_residual_scale(spark, small_problem):
    A, b = small_problem
    d = make_design(spark, A, b)
    w = np.linspace(-1, 1, 12)
    np.testing.assert_allclose(_arr(linalg.residuals(d, w), "residual"), A @ w - b, rtol=1e-11)
    s = linalg.scale_rows(d, 3.0)
    np.testing.assert_allclose(_arr(s), 3 * A)
    np.testing.assert_allclose(_arr(s, "label"), 3 * b)


def test_aggregates(spark, small_problem):
    A, b = small_problem
    d = make_design(spark, A, b)
    w = np.linspace(-1, 1, 12)
    r = A @ w - b
    res_df = linalg.residuals(d, w)
    assert abs(linalg.squared_error(res_df).first()[0] - 0.5 * r @ r) < 1e-9
    g = linalg.vector_np(linalg.transpose_product(res_df), 12, "value")
    np.testing.assert_allclose(g, A.T @ r, rtol=1e-11)
    loss, g2, n = linalg.loss_and_gradient(d, w)
    assert n == 300 and abs(loss - 0.5 * r @ r) < 1e-9
    np.testing.assert_allclose(g2, A.T @ r, rtol=1e-11)
    m = linalg.mean_loss_gradient(d, w).toPandas().sort_values("col_id")
    np.testing.assert_allclose(m["gradient"], A.T @ r / 300, rtol=1e-11)
    sp = linalg.signal_power(d).first()
    assert abs(sp["norm2"] - np.linalg.norm(b)) < 1e-9
    pl = linalg.penalty_level(d, 12).first()
    sigma = math.sqrt(b @ b / 12) * 10 ** -1.5
    assert abs(pl["lambda"] - 2 * sigma * math.sqrt(2 * math.log(12))) < 1e-9


def test_vector_tables(spark):
    a = linalg.vector_table(spark, [1.0, -2.0, 0.5])
    b = linalg.vector_table(spark, [0.5, 1.0])
    c = linalg.vector_np(linalg.combine_vectors(a, 2.0, b, -1.0), 3, "weight")
    np.testing.assert_allclose(c, [1.5, -5.0, 1.0])
    assert linalg.inner_product_vectors(a, b).first()[0] == 0.5 - 2.0
    st = linalg.vector_np(linalg.soft_threshold_table(a, 0.75), 3, "weight")
    np.testing.assert_allclose(st, [0.25, -1.25, 0.0])
    assert linalg.l1_penalty(a, 2.0).first()[0] == 7.0
    g = linalg.vector_table(spark, [1.0, 1.0, 1.0], "gradient")
    ps = linalg.prox_step(a, g, 0.5, 4, 1.0).toPandas().sort_values("col_id")
    v = np.array([1.0, -2.0, 0.5]) - 0.25
    expect = np.sign(v) * np.maximum(np.abs(v) - 0.25, 0)
    np.testing.assert_allclose(ps["weight"], expect)


def test_soft_threshold_column(spark):
    df = spark.createDataFrame([(2.0,), (-0.5,), (0.0,)], "v double")
    out = [r[0] for r in df.select(cols.soft_threshold("v", 1.0)).collect()]
    assert out == [1.0, 0.0, 0.0] and all(str(x) != "-0.0" for x in out)
