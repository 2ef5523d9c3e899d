"""Fits of a few known columns by SQL aggregates (F2-F4 of round 3)."""

import numpy as np
import pytest

from conftest import SF001, make_design
from penfit import catalog
from penfit.operators import linalg, passes
from penfit.plans import FitConfig, evaluators, fit_accelerated
from penfit.plans.evaluators import DenseEvaluator, NarrowEvaluator, make_evaluator
from penfit.sources.design import design_from_columns, known_width


def narrow(spark, A, b, partitions=3):
    rows = spark.createDataFrame([(float(y), *map(float, r)) for y, r in zip(b, A)],
                                 ["y", *[f"c{i}" for i in range(A.shape[1])]])
    return design_from_columns(rows.repartition(partitions), "y", [f"c{i}" for i in range(A.shape[1])])


@pytest.fixture()
def problem():
    rng = np.random.default_rng(11)
    return rng.standard_normal((400, 5)), rng.standard_normal(400)


def test_passes_agree_with_the_arrow_passes(spark, problem):
    A, b = problem
    d = narrow(spark, A, b)
    ev, dense = make_evaluator(d, FitConfig()), DenseEvaluator(d)
    assert type(ev) is NarrowEvaluator and (ev.n, ev.p) == (400, 5)
    V = np.random.default_rng(1).standard_normal((5, 3))
    for flags, grads in (([True] * 3, [0, 1]), ([True, True, False], [1]), ([False, True, True], [])):
        x, y = ev.evaluate(V, flags, grads), dense.evaluate(V, flags, grads)
        np.testing.assert_allclose(x.cross, y.cross, rtol=1e-12, atol=1e-10)
        np.testing.assert_allclose(x.grads, y.grads, rtol=1e-12, atol=1e-10)
        np.testing.assert_allclose(x.losses, y.losses, rtol=1e-12)
    g = ev.gram()
    np.testing.assert_allclose(g.G, A.T @ A, rtol=1e-11, atol=1e-11)
    np.testing.assert_allclose(g.c, A.T @ b, rtol=1e-11, atol=1e-11)
    ev.close()
    dense.close()


def test_width_is_known_and_checked(spark, problem):
    A, b = problem
    d = narrow(spark, A, b)
    assert known_width(d) == known_width(linalg.normalize_columns(d)) == 5
    assert known_width(make_design(spark, A, b)) is None
    wide = make_design(spark, np.ones((3, 6)), np.ones(3))
    with pytest.raises(ValueError, match="length 5"):
        make_evaluator(d.unionByName(wide.select(d.columns)), FitConfig())
    for x in (float("nan"), float("inf"), None):
        bad = d.unionByName(spark.createDataFrame([(None, x, [1.0] * 5), (None, 1.0, [1.0] * 4 + [x])], d.schema))
        with pytest.raises(ValueError, match="NaN or infinite"):
            make_evaluator(bad, FitConfig())
    with pytest.raises(ValueError, match="no rows"):
        make_evaluator(d.limit(0), FitConfig())


def test_column_norms_in_sql(spark, problem):
    A, b = problem
    A[:, 2] = 0.0
    d = narrow(spark, A, b)
    made = linalg.column_norms(d)
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()
    got = made.toPandas().sort_values("col_id")
    assert got["col_id"].tolist() == list(range(5))
    np.testing.assert_allclose(got["norm"], np.linalg.norm(A, axis=0), rtol=1e-12)
    assert linalg.column_norms(d.limit(0)).count() == 0
    for row in ([1.0] * 4, [1.0] * 4 + [None], None):
        bad = d.unionByName(spark.createDataFrame([(None, 1.0, row)], "row_id bigint, label double, features array<double>"))
        with pytest.raises(Exception, match="length 5"):
            linalg.column_norms(bad).collect()


def test_hot_partition_is_spread(spark):
    rng = np.random.default_rng(3)
    A = rng.standard_normal((60_000, 8))
    d = narrow(spark, A, A[:, 0], 1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(evaluators, "MIN_TASK_BYTES", 1 << 16)
        ev = make_evaluator(d, FitConfig())
        assert ev.tasks >= spark.sparkContext.defaultParallelism
        assert ev.evaluate(np.zeros((8, 1)), [True]).n == 60_000
        ev.close()


@pytest.mark.parametrize("name", ["strategy_agreement", "rmse", "relative_difference", "result_folder"])
def test_a_query_caches_its_design_once_and_fits_without_python(spark, name):
    made = []
    with pytest.MonkeyPatch.context() as m:
        first = NarrowEvaluator.__init__
        m.setattr(NarrowEvaluator, "__init__", lambda self, *a, **k: (made.append(1), first(self, *a, **k))[1])
        m.setattr(passes, "blockify", None)
        m.setattr(evaluators, "blockify", None)
        assert catalog.QUERIES[name](spark, SF001).count() > 0
    assert len(made) == 1


def test_fit_agrees_with_the_arrow_fit(spark, problem):
    A, b = problem
    d = narrow(spark, A, b)
    for strategy in ("gradient", "fused"):
        cfg = FitConfig(max_iter=6, L0=10.0, convergence_test=False, strategy=strategy)
        dense = DenseEvaluator(d)
        x, y = fit_accelerated(d, 3.0, cfg), fit_accelerated(d, 3.0, cfg, evaluator=dense)
        dense.close()
        np.testing.assert_allclose(x.weights, y.weights, rtol=1e-8)
        assert [h["evaluations"] for h in x.history] == [h["evaluations"] for h in y.history]
