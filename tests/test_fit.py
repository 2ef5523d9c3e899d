import math

import numpy as np
import pytest

import reference_loops as ref
from conftest import SF01, make_design
from penfit.plans import FitConfig, fit_accelerated, fit_gradient_descent
from penfit.sources.design import to_cells

ITERS = 25
BASE = FitConfig(max_iter=ITERS, L0=10.0, convergence_test=False, backtrack_order="reference")


@pytest.fixture(scope="module")
def design(spark):
    rng = np.random.default_rng(7)
    A = rng.standard_normal((300, 12))
    w = np.zeros(12)
    w[[1, 4, 7]] = [2.0, -3.0, 1.5]
    b = A @ w + 0.1 * rng.standard_normal(300)
    return A, b, make_design(spark, A, b, partitions=3)


@pytest.mark.parametrize("strategy", ["gradient", "fused", "gram"])
@pytest.mark.parametrize("order", ["reference", "safe"])
def test_accelerated_reaches_the_coordinate_descent_solution(design, strategy, order):
    A, b, d = design
    lam = 5.0
    r = fit_accelerated(d, lam, BASE.with_(strategy=strategy, backtrack_order=order, max_iter=250,
                                           convergence_test=True, tol=1e-11))
    np.testing.assert_allclose(r.weights, ref.coordinate_descent(A, b, lam), rtol=1e-6, atol=1e-8)
    best = 0.5 * np.sum((A @ r.weights - b) ** 2) + lam * np.abs(r.weights).sum()
    assert abs(r.history[-1]["objective"] - best) <= 1e-9 * best
    assert min(h["objective"] for h in r.history) >= best * (1 - 1e-9)


def test_strategies_agree_step_by_step(design):
    A, b, d = design
    runs = {s: fit_accelerated(d, 5.0, BASE.with_(strategy=s)) for s in ("gradient", "fused", "gram")}
    # Gram losses (1/2 v'Gv - c'v + 1/2 b'b) cancel; the difference bound
    # amplifies that rounding, so the Gram strategy gets 1e-7.
    for s, tol in (("gradient", 1e-9), ("gram", 1e-7)):
        np.testing.assert_allclose(runs[s].weights, runs["fused"].weights, rtol=tol, atol=1e-10)
        np.testing.assert_allclose([h["objective"] for h in runs[s].history],
                                   [h["objective"] for h in runs["fused"].history], rtol=tol)


@pytest.mark.parametrize("alpha,beta", [(0.9, 0.5), (0.5, 0.8), (1.0, 0.9)])
def test_every_accepted_step_has_a_sufficient_estimate(design, alpha, beta):
    """The accepted L is an upper bound of the curvature along the step, so
    it never has to exceed the largest eigenvalue by more than 1 / beta (first
    steps only: later the losses cancel)."""
    A, b, d = design
    top = np.linalg.eigvalsh(A.T @ A)[-1]
    r = fit_accelerated(d, 5.0, BASE.with_(strategy="gradient", alpha=alpha, beta=beta, max_iter=6))
    assert all(0 < h["lipschitz"] <= max(10.0, top / beta) * (1 + 1e-9) for h in r.history)
    assert all(0 < h["theta"] <= 1 for h in r.history)


class ElasticNet:
    """lam (|w|_1 / 2 + w.w / 4): a user's penalty."""

    def __init__(self, lam):
        self.lam = lam

    def value(self, w):
        return self.lam * (0.5 * np.abs(w).sum() + 0.25 * float(w @ w))

    def prox(self, v, t):
        return ref.soft(v, 0.5 * self.lam * t) / (1 + 0.5 * self.lam * t)


def test_user_penalty(design):
    A, b, d = design
    r = fit_accelerated(d, ElasticNet(10.0), FitConfig(max_iter=400, tol=1e-11, strategy="fused"))
    # the quadratic part is five more rows sqrt(5) * I with label 0
    wide = np.vstack([A, np.sqrt(5.0) * np.eye(12)])
    w = ref.coordinate_descent(wide, np.r_[b, np.zeros(12)], 5.0)
    np.testing.assert_allclose(r.weights, w, rtol=1e-6, atol=1e-8)


def test_user_loss(design):
    class Huber:  # local, so it travels to the workers by value
        """Quadratic up to 1, linear beyond."""

        @staticmethod
        def value_np(r):
            a = np.abs(r)
            return float(np.where(a <= 1, 0.5 * r * r, a - 0.5).sum())

        @staticmethod
        def derivative_np(r):
            return np.clip(r, -1.0, 1.0)

    A, b, d = design
    r = fit_accelerated(d, 0.0, FitConfig(max_iter=300, tol=1e-11, strategy="gradient", loss=Huber()))
    gradient = A.T @ Huber.derivative_np(A @ r.weights - b)
    assert np.abs(gradient).max() < 1e-5 * np.abs(A.T @ b).max()
    with pytest.raises(ValueError):
        FitConfig(strategy="gram", loss=Huber())


@pytest.mark.parametrize("rows,message", [
    ([(0, 0, None)], "null"), ([(0, 0, float("nan"))], "NaN"), ([(7, 0, 1.0)], "without a label"),
    ([(0, 5, 1.0)], "outside"), ([(0, 0, 1.0), (0, 0, 2.0)], "more than once"),
    ([(None, 0, 1.0)], "null row_id"), ([(0, -1, 1.0)], "negative")])
def test_bad_cells_raise(spark, rows, message):
    good = [(0, 1, 1.0), (1, 0, 2.0)]
    cells = spark.createDataFrame(good + rows, "row_id bigint, col_id int, value double")
    labels = spark.createDataFrame([(0, 1.0), (1, 2.0)], "row_id bigint, label double")
    from penfit.plans.evaluators import CellEvaluator
    with pytest.raises(ValueError, match=message):
        CellEvaluator(cells, labels, p=2)


def test_bad_dense_rows_raise_in_the_cell_layout(spark):
    for rows in ([(0, 1.0, [1.0, None])], [(0, 1.0, None)], [(0, 1.0, [float("nan"), 1.0])]):
        d = spark.createDataFrame([(1, 2.0, [1.0, 2.0])] + rows,
                                  "row_id bigint, label double, features array<double>")
        with pytest.raises(Exception, match="null"):
            fit_accelerated(d, 0.1, FitConfig(layout="cells", max_iter=2))


def test_history_tail(spark, design):
    r = fit_accelerated(design[2], 5.0, BASE.with_(strategy="gram", max_iter=9))
    assert [x["iteration"] for x in r.history_tail(spark, 3).collect()] == [7, 8, 9]


def test_scan_counts(design):
    A, b, d = design
    g = fit_accelerated(d, 5.0, BASE.with_(strategy="gradient"))
    f = fit_accelerated(d, 5.0, BASE.with_(strategy="fused"))
    gr = fit_accelerated(d, 5.0, BASE.with_(strategy="gram"))
    inner = sum(h["evaluations"] for h in f.history)
    assert f.scans == 1 + 1 + inner          # validation, start, one per inner step
    inner_g = sum(h["evaluations"] for h in g.history)
    assert f.scans < g.scans <= 1 + 2 * inner_g   # two passes per step unless x == y
    assert gr.scans == 1                     # A^T A, A^T b, b^T b and checks in one scan


def test_gradient_descent_matches_numpy(design):
    A, b, d = design
    w_ref, h_ref = ref.gradient_descent(A, b, 5.0, 30, step=0.001)
    r = fit_gradient_descent(d, 5.0, FitConfig(max_iter=30, convergence_test=False,
                                               step_size=0.001, strategy="fused"))
    np.testing.assert_allclose(r.weights, w_ref, rtol=1e-9, atol=1e-10)
    np.testing.assert_allclose([h["objective"] for h in r.history], h_ref, rtol=1e-9)
    # first entry is 1/2 ||b||^2 at zero weights
    assert abs(r.history[0]["objective"] - 0.5 * b @ b) < 1e-8 * (b @ b)


def test_large_lambda_gives_zero(design):
    A, b, d = design
    lam = float(np.abs(A.T @ b).max()) * 1.0001
    r = fit_accelerated(d, lam, FitConfig(max_iter=50, strategy="fused"))
    assert np.all(r.weights == 0.0)


def test_zero_lambda_is_least_squares(design):
    A, b, d = design
    r = fit_accelerated(d, 0.0, FitConfig(max_iter=500, tol=1e-12, strategy="gram"))
    ls = np.linalg.lstsq(A, b, rcond=None)[0]
    np.testing.assert_allclose(r.weights, ls, rtol=1e-6, atol=1e-8)
    assert r.status == "converged"


def test_optimality_with_convergence(design):
    A, b, d = design
    lam = 5.0
    r = fit_accelerated(d, lam, FitConfig(max_iter=1000, tol=1e-10, strategy="fused"))
    assert r.status == "converged"
    assert ref.l1_residual(A, b, r.weights, lam).max() / lam < 1e-6


def test_sum_form_equals_mean_form_on_scaled(spark, design):
    A, b, d = design
    c = math.sqrt(A.shape[0])
    ds = make_design(spark, A * c, b * c)
    r1 = fit_accelerated(d, 5.0, BASE.with_(strategy="fused"))
    r2 = fit_accelerated(ds, 5.0, BASE.with_(strategy="fused", average=True))
    np.testing.assert_allclose(r1.weights, r2.weights, rtol=1e-8, atol=1e-10)


def test_partitioning_and_order_do_not_matter(spark, design):
    A, b, _ = design
    perm = np.random.default_rng(3).permutation(A.shape[0])
    r1 = fit_accelerated(make_design(spark, A, b, 2), 5.0, BASE.with_(strategy="fused"))
    r2 = fit_accelerated(make_design(spark, A[perm], b[perm], 7), 5.0,
                         BASE.with_(strategy="fused"))
    np.testing.assert_allclose(r1.weights, r2.weights, rtol=1e-9, atol=1e-12)


def test_cell_layout_equals_dense(spark, design):
    A, b, d = design
    r1 = fit_accelerated(d, 5.0, BASE.with_(strategy="fused", max_iter=8))
    cells, labels = to_cells(d)
    r2 = fit_accelerated(None, 5.0, BASE.with_(layout="cells", max_iter=8),
                         cells=cells, labels=labels)
    np.testing.assert_allclose(r1.weights, r2.weights, rtol=1e-9, atol=1e-12)


def test_history_table(spark, design):
    A, b, d = design
    r = fit_accelerated(d, 5.0, BASE.with_(strategy="gram", max_iter=5))
    h = r.history_table(spark).toPandas()
    assert list(h["iteration"]) == [1, 2, 3, 4, 5]
    c = r.coefficients(spark).toPandas()
    assert len(c) == 12 and c["col_id"].tolist() == list(range(12))


def test_edge_designs(spark):
    # one row, one feature
    d = make_design(spark, np.array([[2.0]]), np.array([4.0]), partitions=1)
    r = fit_accelerated(d, 0.0, FitConfig(max_iter=200, tol=1e-12, strategy="fused"))
    assert abs(r.weights[0] - 2.0) < 1e-6
    # all-zero label -> zero weights
    A = np.random.default_rng(0).standard_normal((20, 3))
    r = fit_accelerated(make_design(spark, A, np.zeros(20)), 1.0, FitConfig(strategy="fused"))
    assert np.all(r.weights == 0.0)
    # all-zero column stays zero; duplicate column shares weight
    A2 = np.column_stack([A, np.zeros(20), A[:, 0]])
    b2 = A @ np.array([1.0, 2.0, 3.0])
    r = fit_accelerated(make_design(spark, A2, b2), 0.1,
                        FitConfig(max_iter=300, tol=1e-10, strategy="fused"))
    assert r.weights[3] == 0.0
    assert abs(r.weights[0] + r.weights[4] - 1.0) < 0.05


def test_bad_inputs_raise(spark):
    bad = spark.createDataFrame([(0, float("nan"), [1.0])],
                                "row_id bigint, label double, features array<double>")
    with pytest.raises(ValueError):
        fit_accelerated(bad, 1.0, FitConfig(strategy="fused"))
    empty = spark.createDataFrame([], "row_id bigint, label double, features array<double>")
    with pytest.raises(ValueError):
        fit_accelerated(empty, 1.0, FitConfig(strategy="fused"))
    uneq = spark.createDataFrame([(0, 1.0, [1.0, 2.0]), (1, 1.0, [1.0])],
                                 "row_id bigint, label double, features array<double>")
    with pytest.raises(ValueError):
        fit_accelerated(uneq, 1.0, FitConfig(strategy="fused"))
    nulls = spark.createDataFrame([(0, 1.0, [1.0, None])],
                                  "row_id bigint, label double, features array<double>")
    with pytest.raises(ValueError):
        fit_gradient_descent(nulls, 1.0, FitConfig(strategy="fused"))


def test_price_design_strategies_agree(spark):
    from penfit.catalog import LAMBDA_PRICE, _normalised_price
    d = _normalised_price(spark, SF01)
    fused = fit_accelerated(d, LAMBDA_PRICE, BASE.with_(strategy="fused", max_iter=40))
    gram = fit_accelerated(d, LAMBDA_PRICE, BASE.with_(strategy="gram", max_iter=40))
    rel = np.linalg.norm(fused.weights - gram.weights) / np.linalg.norm(gram.weights)
    assert rel < 1e-7   # Gram losses cancel (see test_strategies_agree_step_by_step)


def test_bad_loss_stops_with_last_good_weights(spark):
    # finite inputs whose squares overflow: the loss at y is infinite
    A = np.array([[1e200, 1.0], [2e200, -1.0]])
    b = np.array([1.0, 2.0])
    r = fit_accelerated(make_design(spark, A, b), 1.0, FitConfig(max_iter=5, strategy="fused"))
    assert r.status == "bad_loss"
    assert np.all(np.isfinite(r.weights))


@pytest.mark.parametrize("strategy", ["gram", "fused"])
def test_price_design_converges_to_optimality(spark, strategy):
    """SURVEY 7.2 step 1: on D1 with lambda 500 (label in thousands) the L1
    optimality residual falls below 1e-6 lambda with the convergence test on."""
    from penfit.catalog import LAMBDA_PRICE, _normalised_price
    from penfit.operators import linalg
    d = _normalised_price(spark, SF01)
    r = fit_accelerated(d, LAMBDA_PRICE, FitConfig(max_iter=2000, tol=1e-10, L0=10.0,
                                                   strategy=strategy))
    assert r.status == "converged"
    _, g, _ = linalg.loss_and_gradient(d, r.weights)
    w = r.weights
    res = np.where(w != 0, np.abs(g + LAMBDA_PRICE * np.sign(w)),
                   np.maximum(np.abs(g) - LAMBDA_PRICE, 0.0))
    assert res.max() / LAMBDA_PRICE < 1e-6


def test_skewed_partitions_are_rebalanced(spark, design):
    from penfit.plans.evaluators import DenseEvaluator
    from penfit.operators import passes
    A, b, d = design
    # one partition holds 90 % of the rows; blocks of 10 rows so they can move
    rows = make_design(spark, A, b, partitions=1)
    skewed = rows.limit(270).repartition(1).union(rows.subtract(rows.limit(270)).repartition(9))
    old = passes.MAX_BLOCK_BYTES
    passes.MAX_BLOCK_BYTES = 8 * 12 * 10
    try:
        ev = DenseEvaluator(skewed)
        try:
            assert ev.rebalanced
            r = ev.evaluate(np.ones((12, 1)), [True], [0])
            np.testing.assert_allclose(r.grads[:, 0], A.T @ (A @ np.ones(12) - b), rtol=1e-10)
        finally:
            ev.close()
    finally:
        passes.MAX_BLOCK_BYTES = old


def test_checkpointed_design_same_result(design):
    A, b, d = design
    r1 = fit_accelerated(d, 5.0, BASE.with_(strategy="fused", max_iter=10))
    r2 = fit_accelerated(d, 5.0, BASE.with_(strategy="fused", max_iter=10, checkpoint=True))
    np.testing.assert_allclose(r1.weights, r2.weights, rtol=1e-12, atol=1e-14)


def test_gram_final_loss_rechecked_when_cancelling(spark):
    # nearly exact fit: the optimum loss is ~1e-10 of 1/2 b'b
    rng = np.random.default_rng(5)
    A = rng.standard_normal((200, 5))
    b = A @ np.array([3.0, -1.0, 2.0, 0.5, 1.0]) * 1000 + 1e-3 * rng.standard_normal(200)
    d = make_design(spark, A, b)
    r = fit_accelerated(d, 0.0, FitConfig(max_iter=500, tol=1e-14, strategy="gram"))
    exact = 0.5 * np.sum((A @ r.weights - b) ** 2)
    assert r.scans == 2                       # Gram pass + the exact re-check
    assert abs(r.history[-1]["loss"] - exact) <= 1e-9 * exact


@pytest.mark.parametrize("strategy", ["fused", "gram", "auto", "gradient"])
@pytest.mark.parametrize("checkpoint", [False, True])
def test_the_input_runs_once(spark, design, strategy, checkpoint):
    """Rows upstream of a shuffled join, counted by an accumulator."""
    A, b, d = design
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            seen.add(x.num_rows)
            yield x

    counted = d.mapInArrow(count, d.schema)
    keys = d.select("row_id").repartition(3)
    joined = counted.join(keys.hint("merge"), "row_id")
    r = fit_accelerated(joined, 5.0, BASE.with_(strategy=strategy, checkpoint=checkpoint, max_iter=3))
    assert len(r.history) == 3 and seen.value == len(b)
