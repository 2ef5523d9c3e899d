"""Any loss in residual form, linear-map plug-ins, sparse and column-blocked layouts."""

import contextlib
import importlib
import io

import numpy as np
import pytest

from conftest import make_design
from penfit.functions.loss import Huber, Logistic
from penfit.operators import passes
from penfit.operators.maps import CentredMap, InterceptMap, MatrixMap, adjoint_gap
from penfit.plans import FitConfig, fit_accelerated, fit_gradient_descent

from penfit.plans.evaluators import ColumnBlockEvaluator, DenseEvaluator, SparseEvaluator, make_evaluator
from penfit.sources.design import to_cells

fit_module = importlib.import_module("penfit.plans.fit")

BASE = FitConfig(max_iter=25, L0=10.0, convergence_test=False, backtrack_order="reference")


def problem(n=300, p=12, seed=7):
    rng = np.random.default_rng(seed)
    A = rng.standard_normal((n, p))
    w = np.zeros(p)
    w[[1, 4, 7]] = [2.0, -3.0, 1.5]
    return A, A @ w + 0.1 * rng.standard_normal(n)


@pytest.fixture(scope="module")
def design(spark):
    A, b = problem()
    b[::17] += 30.0  # outliers
    return A, b, make_design(spark, A, b)


# -- any loss -----------------------------------------------------------------

@pytest.mark.parametrize("loss", [Huber(1.0), Logistic()])
@pytest.mark.parametrize("average", [False, True])
def test_any_loss_in_residual_form(design, loss, average):
    A, b, d = design
    cfg = BASE.with_(loss=loss, average=average)
    lam = 0.01 if average else 3.0
    one = fit_accelerated(d, lam, cfg.with_(strategy="gradient"))
    two = fit_accelerated(d, lam, cfg.with_(strategy="fused"))
    assert len(one.history) == len(two.history) == 25
    np.testing.assert_allclose(two.weights, one.weights, rtol=1e-8, atol=1e-10)
    np.testing.assert_allclose([h["objective"] for h in two.history], [h["objective"] for h in one.history], rtol=1e-9)
    # a scan per accepted step, one more for a rejected trial or a restart (and the start)
    extra = sum(h["evaluations"] - 1 for h in two.history) * 2 + sum(h["restarted"] for h in two.history)
    assert two.scans <= 1 + 1 + len(two.history) + extra
    assert two.scans < one.scans


def test_losses_and_their_derivatives():
    a, b = np.linspace(-4, 4, 41), np.where(np.arange(41) % 3 == 0, 1.0, 0.0)
    for loss in (Huber(0.7), Logistic()):
        h = 1e-6
        for i in range(41):
            up, down = a.copy(), a.copy()
            up[i] += h
            down[i] -= h
            slope = (passes.loss_value(loss, up, b) - passes.loss_value(loss, down, b)) / (2 * h)
            assert passes.loss_derivative(loss, a, b)[i] == pytest.approx(slope, abs=1e-5)
    with pytest.raises(ValueError):
        Huber(0.0)


def test_the_optimum_of_a_logistic_fit(spark):
    A, b = problem(seed=3)
    r = fit_accelerated(make_design(spark, A, b), 2.0, FitConfig(max_iter=500, tol=1e-10, loss=Logistic()))
    s = np.where(b > 0, 1.0, -1.0)
    g = A.T @ (-s / (1 + np.exp(s * (A @ r.weights))))
    on = r.weights != 0
    assert on.any() and np.abs(g[on] + 2.0 * np.sign(r.weights[on])).max() < 1e-4
    assert np.abs(g[~on]).max(initial=0) <= 2.0 + 1e-4


# -- one gradient a scan --------------------------------------------------------

def test_recombined_gradients_stay_exact(design, monkeypatch):
    A, b, d = design
    asked = []
    scan = DenseEvaluator.scan

    def counted(self, V, rows, n_scalars, g):
        asked.append(g)
        return scan(self, V, rows, n_scalars, g)

    cfg = BASE.with_(max_iter=110, restart=False)
    with monkeypatch.context() as m:
        m.setattr(DenseEvaluator, "scan", counted)
        one = fit_accelerated(d, 5.0, cfg)
    with monkeypatch.context() as m:
        m.setattr(fit_module, "REFRESH", 0)  # both gradients in every scan
        both = fit_accelerated(d, 5.0, cfg)
    assert one.scans == both.scans
    np.testing.assert_allclose(one.weights, both.weights, rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose([h["objective"] for h in one.history], [h["objective"] for h in both.history], rtol=1e-9)
    # two at the start and after every 50 recombinations, else one
    assert asked.count(2) <= 6 and asked.count(1) == len(asked) - asked.count(2)  # a rejected trial may refresh twice


# -- maps -------------------------------------------------------------------------

@pytest.mark.parametrize("strategy", ["gradient", "fused"])
def test_centred_map(spark, design, strategy):
    A, b, d = design
    shifted = make_design(spark, A + 5.0, b)
    got = fit_accelerated(shifted, 5.0, BASE.with_(strategy=strategy, linear_map=CentredMap((A + 5.0).mean(axis=0))))
    want = fit_accelerated(make_design(spark, A - A.mean(axis=0), b), 5.0, BASE.with_(strategy=strategy))
    # the difference bound of the first steps amplifies rounding
    np.testing.assert_allclose(got.weights, want.weights, rtol=1e-6, atol=1e-8)
    assert fit_gradient_descent(shifted, 5.0, BASE.with_(step_size=1e-4, linear_map=CentredMap(np.full(12, 5.0)))).p == 12


def test_intercept_map(spark, design):
    A, b, d = design
    got = fit_accelerated(d, None, FitConfig(max_iter=400, tol=1e-12, linear_map=InterceptMap()))
    want = np.linalg.lstsq(np.column_stack([np.ones(len(b)), A]), b, rcond=None)[0]
    assert got.p == 13
    np.testing.assert_allclose(got.weights, want, rtol=1e-5, atol=1e-7)
    huber = fit_accelerated(d, None, FitConfig(max_iter=400, tol=1e-11, linear_map=InterceptMap(), loss=Huber(1.0)))
    # outliers pull the intercept of the squares, hardly that of the other
    assert abs(huber.weights[0]) < 0.3 < got.weights[0]


def test_user_map_and_adjoint_check(spark, design):
    class Squares:  # local, so it travels to the workers by value
        """The rows' features and their squares."""

        def coefficients(self, width):
            return 2 * width

        def raw_width(self, p):
            return p // 2

        def apply(self, M, V):
            return np.hstack([M, M * M]) @ V

        def adjoint(self, M, S):
            return np.hstack([M, M * M]).T @ S

    A, b, d = design
    got = fit_accelerated(d, 5.0, BASE.with_(linear_map=Squares()))
    want = fit_accelerated(make_design(spark, np.hstack([A, A * A]), b), 5.0, BASE)
    np.testing.assert_allclose(got.weights, want.weights, rtol=1e-8, atol=1e-10)
    for m in (Squares(), CentredMap(A.mean(axis=0)), InterceptMap(), MatrixMap()):
        ev = DenseEvaluator(d, linear_map=m)
        assert adjoint_gap(ev) < 1e-12
        ev.close()

    class Wrong(CentredMap):
        def adjoint(self, M, S):
            return M.T @ S
    ev = DenseEvaluator(d, linear_map=Wrong(A.mean(axis=0) + 1.0))
    assert adjoint_gap(ev) > 1e-3
    ev.close()
    with pytest.raises(ValueError):
        FitConfig(strategy="gram", linear_map=InterceptMap())


# -- sparse -----------------------------------------------------------------------

@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(5)
    A = np.where(rng.random((200, 40)) < 0.08, rng.standard_normal((200, 40)), 0.0)
    A[3] = 0.0
    w = np.zeros(40)
    w[::9] = 2.0
    b = A @ w + 0.05 * rng.standard_normal(200)
    return A, b, make_design(spark, A, b)


@pytest.mark.parametrize("loss", [None, Huber(0.5)])
def test_sparse_blocks_give_the_dense_fit(sparse, loss, monkeypatch):
    A, b, d = sparse
    monkeypatch.setattr(passes, "DRIVER_MERGE_BYTES", 0)  # the block-wise sum
    cells, labels = to_cells(d)
    cfg = BASE.with_(loss=loss)
    want = fit_accelerated(d, 0.5, cfg)
    got = fit_accelerated(None, 0.5, cfg.with_(layout="sparse", columns=40), cells=cells, labels=labels)
    np.testing.assert_allclose(got.weights, want.weights, rtol=1e-8, atol=1e-10)
    assert got.n == 200 and got.scans == want.scans
    again = fit_accelerated(d, 0.5, cfg.with_(layout="sparse", columns=40))
    np.testing.assert_allclose(again.weights, want.weights, rtol=1e-8, atol=1e-10)


def test_sparse_partials_have_the_touched_blocks_only(spark):
    p = 100_000
    cells = spark.createDataFrame([(0, 5, 1.0), (0, 99_999, 2.0), (1, 5, 3.0)], "row_id bigint, col_id int, value double")
    labels = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "row_id bigint, label double")
    ev = SparseEvaluator(cells, labels, p)
    x = np.zeros(p)
    x[5], x[99_999] = 1.0, 0.5
    r = ev.evaluate(x.reshape(-1, 1), [True], [0])
    g = np.zeros(p)
    g[5], g[99_999] = (2.0 - 1.0) + 3.0 * (3.0 - 2.0), 2.0
    np.testing.assert_allclose(r.grads[:, 0], g, atol=1e-12)
    assert r.losses[0] == pytest.approx(0.5 * (1.0 + 1.0 + 16.0)) and adjoint_gap(ev) < 1e-12
    ev.close()
    sums = passes.ColumnSums(p, 1)
    sums.add(np.array([5, 99_999, 5]), np.array([[1.0], [2.0], [3.0]]))
    (batch,) = sums.emit(np.array([7.0, 8.0]))
    assert batch.column(0).to_pylist() == [0, 12]


def test_bad_sparse_cells_raise(spark):
    labels = spark.createDataFrame([(0, 1.0)], "row_id bigint, label double")
    for cell, message in (((0, 9, 1.0), "outside"), ((7, 0, 1.0), "without a label"), ((0, 0, float("nan")), "NaN")):
        cells = spark.createDataFrame([cell], "row_id bigint, col_id int, value double")
        with pytest.raises(ValueError, match=message):
            fit_accelerated(None, 1.0, BASE.with_(layout="sparse", columns=5), cells=cells, labels=labels)


# -- column blocks -----------------------------------------------------------------

@pytest.mark.parametrize("loss,strategy", [(None, "fused"), (Huber(1.0), "fused"), (None, "gradient")])
def test_vectors_above_the_bound_take_column_blocks(design, loss, strategy, monkeypatch):
    A, b, d = design
    cfg = BASE.with_(loss=loss, strategy=strategy, max_iter=8)
    want = fit_accelerated(d, 5.0, cfg)
    monkeypatch.setattr(passes, "MAX_BROADCAST_BYTES", 100)
    monkeypatch.setattr("penfit.plans.evaluators.COLUMN_BLOCK", 5)
    monkeypatch.setattr("penfit.plans.evaluators.SLICE_BYTES", 4000)
    ev = make_evaluator(d, cfg)
    assert isinstance(ev, ColumnBlockEvaluator) and ev.columns == 3 and ev.slices > 1
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        ev.products(np.ones((12, 1))).explain()
    plan = buf.getvalue()
    assert "Broadcast" not in plan
    # of the two sides of the cogroup only the coefficients are shuffled
    above = plan.split("InMemoryRelation")[0]
    assert above.count("Exchange") <= 1
    ev.close()
    got = fit_accelerated(d, 5.0, cfg)
    np.testing.assert_allclose(got.weights, want.weights, rtol=1e-9, atol=1e-11)
    assert got.scans == want.scans
