"""Registered queries over the driver's tables and their DuckDB oracles.

Every query reads the given tables (or data Spark derives from them) in full.
Doubles leave both engines rounded to 7 significant digits by one shared SQL
expression (``sig``), so sums taken in different orders compare equal.
"""

from __future__ import annotations

import contextlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penfit.functions.loss import Huber
from penfit.operators import compare, linalg, vectors
from penfit.operators.maps import CentredMap
from penfit.plans import FitConfig, fit_accelerated, fit_gradient_descent
from penfit.plans.evaluators import ColumnBlockEvaluator, DenseEvaluator, GramEvaluator, make_evaluator
from penfit.session import unique_path
from penfit.sources import design as dsg
from penfit.sources import results as res
from penfit.sources.tables import EVENT_SLOTS, embedding_design, event_cells, load_table, price_design

# Fixed parameters of the registered queries.
W_EMB = [(j + 1) / 64.0 for j in range(64)]        # weights i+1 (scaled) on D2
W_PRICE = [10.0, 0.0, 0.0, 0.0, 1.0, 0.0]           # weights on D1
LAMBDA_PRICE = 500.0                                 # penalty on normalised D1
LAMBDA_EMB = 0.5
GD_ITERS = 30
LABEL_UNIT = 1000.0                                  # fit label: price in thousands
ACC_ITERS = 20
CONVERGED_TOL = 0.01
BAD_STEP = 1e80


def sig(x: str, digits: int = 6) -> str:
    """SQL text valid in Spark and DuckDB: x rounded to digits+1 significant
    digits (exact powers of ten; -0.0 becomes 0.0)."""
    x = f"({x})"
    e = f"floor(log10(abs({x})))"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) OR {x} = 0 THEN {x} + 0.0 "
            f"WHEN {e} >= 0 THEN round({x} / power(10, {e}), {digits}) * power(10, {e}) "
            f"ELSE round({x} * power(10, -{e}), {digits}) / power(10, -{e}) END)")


def rounded(df: DataFrame) -> DataFrame:
    """Apply ``sig`` to every DOUBLE column, keep the rest."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType):
            out.append(F.expr(sig(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


# ---------------------------------------------------------------- SQL pieces
D1 = """d1 AS (SELECT CAST(l_extendedprice AS DOUBLE) AS label,
  [CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE),
   CAST(l_linenumber AS DOUBLE), CAST(p_retailprice AS DOUBLE), CAST(p_size AS DOUBLE)] AS features
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
D2 = """d2 AS (SELECT vec_id AS row_id, CAST(label AS DOUBLE) AS label,
  CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"""
C2 = """c2 AS (SELECT row_id, label, unnest(features) AS value,
  CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS col_id FROM d2)"""
P2 = """p2 AS (SELECT row_id, label, sum(value * (col_id + 1) / 64.0) AS prediction
  FROM c2 GROUP BY row_id, label)"""
R2 = """r2 AS (SELECT row_id, label, prediction, prediction - label AS residual FROM p2)"""
G2 = """g2 AS (SELECT c2.col_id, sum(c2.value * r2.residual) AS value
  FROM c2 JOIN r2 ON c2.row_id = r2.row_id GROUP BY c2.col_id)"""
W_PRICE_SQL = "[" + ", ".join(f"{w:.1f}" for w in W_PRICE) + "]"
R1 = f"""r1 AS (SELECT label, features, list_dot_product(features, {W_PRICE_SQL}) - label AS r
  FROM d1)"""
C1R = """c1r AS (SELECT unnest(features) AS value,
  CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS col_id, r FROM r1)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _s(x: str) -> str:
    return sig(x)


# ------------------------------------------------------------ Spark queries
def q_column_norms(spark, sf):
    return rounded(linalg.column_norms(embedding_design(spark, sf)))


def q_column_norms_price(spark, sf):
    return rounded(linalg.column_norms(price_design(spark, sf)))


def q_normalized_cells(spark, sf):
    d = linalg.normalize_columns(embedding_design(spark, sf))
    return rounded(linalg.exploded(d, "row_id"))


def q_scaled_rows(spark, sf):
    d = embedding_design(spark, sf)
    c = math.sqrt(d.count())
    s = linalg.scale_rows(d, c)
    return rounded(linalg.exploded(s, "row_id", "label"))


def q_predict(spark, sf):
    return rounded(linalg.predict(embedding_design(spark, sf), W_EMB)
                   .select("row_id", "prediction"))


def q_residual(spark, sf):
    return rounded(linalg.residuals(embedding_design(spark, sf), W_EMB)
                   .select("row_id", "residual"))


def q_combine(spark, sf):
    from penfit.functions.columns import combine
    r = linalg.predict(embedding_design(spark, sf), W_EMB)
    return rounded(r.select("row_id", combine("prediction", 1.0, "label", 1000.0).alias("combined")))


def _grad_emb(spark, sf, w):
    return linalg.transpose_product(linalg.residuals(embedding_design(spark, sf), w))


def q_combine_vectors(spark, sf):
    d = embedding_design(spark, sf)
    norms = linalg.column_norms(d).withColumnRenamed("norm", "weight")
    grad = _grad_emb(spark, sf, W_EMB).withColumnRenamed("value", "weight")
    return rounded(linalg.combine_vectors(norms, 1.0, grad, -0.001))


def q_inner_product(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return rounded(linalg.inner_product(li, "l_quantity", "l_extendedprice"))


def q_inner_product_vectors(spark, sf):
    d = embedding_design(spark, sf)
    norms = linalg.column_norms(d).withColumnRenamed("norm", "weight")
    grad = _grad_emb(spark, sf, W_EMB).withColumnRenamed("value", "weight")
    return rounded(linalg.inner_product_vectors(norms, grad))


def q_squared_error(spark, sf):
    return rounded(linalg.squared_error(linalg.residuals(price_design(spark, sf), W_PRICE)))


def q_transpose_product(spark, sf):
    return rounded(_grad_emb(spark, sf, W_EMB))


def q_mean_loss_gradient(spark, sf):
    return rounded(linalg.mean_loss_gradient(price_design(spark, sf), W_PRICE))


def q_loss_gradient(spark, sf):
    """O27 fused Arrow pass: one scan for loss and gradient (sum form)."""
    loss, grad, n = linalg.loss_and_gradient(price_design(spark, sf), W_PRICE)
    out = linalg.vector_table(spark, grad, "gradient") \
        .withColumn("loss", F.lit(loss)).withColumn("n", F.lit(n).cast("bigint"))
    return rounded(out)


def q_soft_threshold(spark, sf):
    g = _grad_emb(spark, sf, [0.0] * 64).withColumnRenamed("value", "weight")
    return rounded(linalg.soft_threshold_table(g, 50.0))


def q_prox_step(spark, sf):
    w = linalg.vector_table(spark, W_EMB, "weight")
    g = _grad_emb(spark, sf, W_EMB).withColumnRenamed("value", "gradient")
    return rounded(linalg.prox_step(w, g, 0.1, 4, 1.0))


def q_l1_penalty(spark, sf):
    g = _grad_emb(spark, sf, [0.0] * 64).withColumnRenamed("value", "weight")
    return rounded(linalg.l1_penalty(g, LAMBDA_EMB))


def q_objective(spark, sf):
    return rounded(linalg.objective(embedding_design(spark, sf), W_EMB, LAMBDA_EMB))


def _cells_emb(spark, sf):
    return dsg.to_cells(embedding_design(spark, sf), keep_zeros=True)


def q_cell_norms(spark, sf):
    cells, _ = _cells_emb(spark, sf)
    return rounded(linalg.column_norms_cells(cells))


def q_cell_normalized(spark, sf):
    cells, _ = _cells_emb(spark, sf)
    return rounded(linalg.normalize_cells(cells, p=64))


def q_cell_predict(spark, sf):
    cells, labels = _cells_emb(spark, sf)
    w = linalg.vector_table(spark, W_EMB, "weight")
    return rounded(linalg.predict_cells(cells, labels, w).select("row_id", "prediction"))


def q_cell_transpose_product(spark, sf):
    cells, labels = _cells_emb(spark, sf)
    w = linalg.vector_table(spark, W_EMB, "weight")
    pred = linalg.predict_cells(cells, labels, w)
    res_ = pred.select("row_id", (F.col("prediction") - F.col("label")).alias("residual"))
    return rounded(linalg.transpose_product_cells(cells, res_))


def q_cell_fit(spark, sf):
    """O44 cell layout: the accelerated fit evaluated with SQL joins and
    group-bys (no Arrow), 10 iterations on the embedding design."""
    cells, labels = _cells_emb(spark, sf)
    cfg = FitConfig(max_iter=CELL_FIT_ITERS, L0=10.0, convergence_test=False, layout="cells",
                    backtrack_order="reference")
    r = fit_accelerated(None, LAMBDA_EMB, cfg, cells=cells, labels=labels)
    return rounded(r.coefficients(spark))


def q_signal_power(spark, sf):
    return rounded(linalg.signal_power(price_design(spark, sf)))


def q_penalty_level(spark, sf):
    return rounded(linalg.penalty_level(price_design(spark, sf), p=6))


def q_align_counts(spark, sf):
    d = embedding_design(spark, sf)
    joined = dsg.align(dsg.select_label(d), dsg.select_features(d))
    return joined.agg(F.count(F.lit(1)).alias("n_joined"),
                      F.sum(F.size("features")).cast("bigint").alias("n_cells"))


def q_row_count(spark, sf):
    n = dsg.row_count(price_design(spark, sf))
    return spark.createDataFrame([(n,)], "n bigint")


def q_peek(spark, sf):
    d = embedding_design(spark, sf)
    return rounded(dsg.peek(d, 10).select("row_id", "label",
                                          F.size("features").alias("n_features")))


def q_design_roundtrip(spark, sf):
    path = unique_path(spark, "design")
    dsg.write_design(embedding_design(spark, sf), path)
    back = dsg.read_design(spark, path)
    return rounded(back.select("row_id", "label", F.aggregate("features", F.lit(0.0),
                                                              lambda a, v: a + v * v)
                               .alias("sum_sq")))


def _normalised_price(spark, sf):
    """Price design with the label in thousands and unit-norm (uncentred)
    columns: the fit problem of the registered fit queries."""
    d = price_design(spark, sf).withColumn("label", F.col("label") / F.lit(LABEL_UNIT))
    return linalg.normalize_columns(d)


def q_gradient_descent(spark, sf):
    """O31 on normalised D1, 30 steps of 0.1/sqrt(k), lambda 500."""
    cfg = FitConfig(max_iter=GD_ITERS, convergence_test=False, step_size=0.1)
    r = fit_gradient_descent(_normalised_price(spark, sf), LAMBDA_PRICE, cfg)
    return rounded(r.coefficients(spark))


def q_gradient_descent_history(spark, sf):
    cfg = FitConfig(max_iter=GD_ITERS, convergence_test=False, step_size=0.1)
    r = fit_gradient_descent(_normalised_price(spark, sf), LAMBDA_PRICE, cfg)
    return rounded(r.history_table(spark).select("iteration", "objective"))


def q_accelerated(spark, sf):
    """O32-O39 on normalised D1: 20 iterations, L0 10, no convergence test,
    reference backtracking order."""
    cfg = FitConfig(max_iter=ACC_ITERS, L0=10.0, convergence_test=False,
                    backtrack_order="reference", strategy="fused")
    r = fit_accelerated(_normalised_price(spark, sf), LAMBDA_PRICE, cfg)
    return rounded(r.coefficients(spark))


def q_optimality(spark, sf):
    """L1 optimality residual of the accelerated weights, per
    coefficient: |g + lam sign(w)| where w != 0, max(|g| - lam, 0) where w = 0."""
    cfg = FitConfig(max_iter=ACC_ITERS, L0=10.0, convergence_test=False,
                    backtrack_order="reference", strategy="fused")
    d = _normalised_price(spark, sf)
    r = fit_accelerated(d, LAMBDA_PRICE, cfg)
    _, g, _ = linalg.loss_and_gradient(d, r.weights)
    w = linalg.vector_table(spark, r.weights, "weight")
    gt = linalg.vector_table(spark, g, "gradient")
    lam = F.lit(LAMBDA_PRICE)
    res_ = F.when(F.col("weight") != 0.0, F.abs(F.col("gradient") + lam * F.signum("weight"))) \
        .otherwise(F.greatest(F.abs("gradient") - lam, F.lit(0.0)))
    return rounded(w.join(gt, "col_id").select("col_id", "weight", "gradient",
                                                res_.alias("residual")))


def _fits(spark, sf, iters=ACC_ITERS):
    d = _normalised_price(spark, sf)
    out = {}
    base = FitConfig(max_iter=iters, L0=10.0, convergence_test=False,
                     backtrack_order="reference")
    with _one_design(d, base) as ev:
        for strat in ("gradient", "fused"):
            out[strat] = fit_accelerated(d, LAMBDA_PRICE, base.with_(strategy=strat), evaluator=ev)
        out["gram"] = fit_accelerated(d, LAMBDA_PRICE, base.with_(strategy="gram"),
                                      evaluator=GramEvaluator(gram=ev.gram(), scans=1))
        out["gd"] = fit_gradient_descent(d, LAMBDA_PRICE, base.with_(step_size=0.1), evaluator=ev)
    return out


@contextlib.contextmanager
def _one_design(d, cfg):
    """An evaluator that several fits of a design share: its rows are made and cached once."""
    ev = make_evaluator(d, cfg)
    try:
        yield ev
    finally:
        ev.close()


def q_strategy_agreement(spark, sf):
    """The weights of every strategy of the accelerated fit."""
    fits = _fits(spark, sf)
    parts = [fits[m].coefficients(spark).withColumn("method", F.lit(m))
             for m in ("gradient", "fused", "gram")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def q_same_iterations(spark, sf):
    """O47 on the events table: rows per event type as history lengths."""
    ev = load_table(spark, sf, "events")
    return compare.same_iterations(ev.select(F.col("event_type").alias("method")))


def q_timing_table(spark, sf):
    """O48 on the events table: a value per event, in nanoseconds, by type."""
    ev = load_table(spark, sf, "events")
    return rounded(compare.timing_table(ev.select(F.col("event_type").alias("method"),
                                                  (F.col("value") * 1e6).alias("ns"))))


def _both_fits(spark, sf):
    """Gradient descent and the accelerated fit of one cached design."""
    d = _normalised_price(spark, sf)
    descent = FitConfig(max_iter=GD_ITERS, convergence_test=False, step_size=0.1)
    with _one_design(d, descent) as ev:
        gd = fit_gradient_descent(d, LAMBDA_PRICE, descent, evaluator=ev)
        acc = fit_accelerated(d, LAMBDA_PRICE, FitConfig(
            max_iter=ACC_ITERS, L0=10.0, convergence_test=False, backtrack_order="reference",
            strategy="fused"), evaluator=ev)
    return gd, acc


def _gd_and_accelerated(spark, sf):
    gd, acc = _both_fits(spark, sf)
    return gd.coefficients(spark).withColumn("method", F.lit("gd")).unionByName(
        acc.coefficients(spark).withColumn("method", F.lit("accelerated")))


def q_relative_difference(spark, sf):
    """Gradient descent weights against accelerated weights."""
    return rounded(compare.relative_difference(_gd_and_accelerated(spark, sf), "accelerated", "col_id", "weight"))


def q_rmse(spark, sf):
    """The same pair."""
    return rounded(compare.rmse(_gd_and_accelerated(spark, sf), "accelerated", "col_id", "weight"))


def q_gradient_descent_dense(spark, sf):
    """O31 with a pass over the rows per iteration (no Gram matrix)."""
    cfg = FitConfig(max_iter=GD_ITERS, convergence_test=False, step_size=0.1, strategy="fused")
    r = fit_gradient_descent(_normalised_price(spark, sf), LAMBDA_PRICE, cfg)
    return rounded(r.coefficients(spark))


def _accelerated(spark, sf, lam, **settings):
    cfg = FitConfig(max_iter=ACC_ITERS, L0=10.0, convergence_test=False,
                    backtrack_order="reference", strategy="fused").with_(**settings)
    return fit_accelerated(_normalised_price(spark, sf), lam, cfg)


def q_accelerated_gradient_form(spark, sf):
    """Loss and gradient at y and at x, two passes per trial."""
    return rounded(_accelerated(spark, sf, LAMBDA_PRICE, strategy="gradient").coefficients(spark))


def q_accelerated_history(spark, sf):
    """Objective and accepted Lipschitz estimate per iteration."""
    h = _accelerated(spark, sf, LAMBDA_PRICE).history_table(spark)
    return rounded(h.select("iteration", "objective", "lipschitz"))


def q_history_tail(spark, sf):
    """The last five history rows."""
    r = _accelerated(spark, sf, LAMBDA_PRICE)
    return rounded(r.history_tail(spark, 5).select("iteration", "objective"))


def q_no_penalty_restarts(spark, sf):
    """No penalty; restarts fire within the 20 iterations."""
    h = _accelerated(spark, sf, None).history_table(spark)
    return rounded(h.select("iteration", "objective", "restarted"))


def q_converged_fit(spark, sf):
    """A fit that its step convergence test ends."""
    r = _accelerated(spark, sf, LAMBDA_PRICE, convergence_test=True, tol=CONVERGED_TOL, max_iter=100)
    return rounded(r.coefficients(spark).withColumn("iterations", F.lit(len(r.history)))
                   .withColumn("status", F.lit(r.status)))


def q_align_documents_labels(spark, sf):
    """J1 over two tables: the labelled documents with their labels."""
    labels = load_table(spark, sf, "labels").select("doc_id", "toxic", "quality")
    docs = load_table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    joined = dsg.align(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, "doc_id")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_joined"), F.sum("n_chars").cast("bigint").alias("n_chars"),
        F.sum("toxic").cast("bigint").alias("toxic"), F.sum("quality").cast("bigint").alias("quality"))


def q_read_or_write(spark, sf):
    """A missing design is made, written and read back; the second call
    reads it; its penalty level goes through a one-row parameter table."""
    path = unique_path(spark, "design")
    made = dsg.read_or_generate(spark, path, lambda: embedding_design(spark, sf))
    again = dsg.read_or_generate(spark, path, lambda: made.limit(0))
    dsg.write_param(spark, f"{path}-param", "n", float(made.count()))
    n = dsg.read_param(spark, f"{path}-param", "n")
    return rounded(again.select("row_id", "label", F.size("features").alias("n_features"))
                   .withColumn("n", F.lit(n)))


def q_history_roundtrip(spark, sf):
    """A GD history written as a result file and read back."""
    cfg = FitConfig(max_iter=GD_ITERS, convergence_test=False, step_size=0.1)
    r = fit_gradient_descent(_normalised_price(spark, sf), LAMBDA_PRICE, cfg)
    path = unique_path(spark, "history")
    _write_numbers(spark, r, path)
    back = res.read_results(spark, {"gd": path})
    return rounded(back)


def _write_numbers(spark, r, path):
    """The reference's result format: one number per line, no header."""
    res.write_numbers(r.history_table(spark), path, "objective", "iteration")


# ------------------------------------------------- losses, maps, layouts, vectors
HUBER_DELTA, LAMBDA_HUBER, HUBER_ITERS = 5.0, 100.0, 10
LAMBDA_EVENTS, EVENT_COLUMNS = 0.5, 40


def q_huber_fit(spark, sf):
    """The residual form of another loss (Huber) on normalised D1."""
    cfg = FitConfig(max_iter=HUBER_ITERS, L0=10.0, convergence_test=False, backtrack_order="reference",
                    loss=Huber(HUBER_DELTA))
    r = fit_accelerated(_normalised_price(spark, sf), LAMBDA_HUBER, cfg)
    h = r.history_table(spark).select("iteration", "objective", "lipschitz")
    return rounded(h.join(r.coefficients(spark).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("col_id", "weight"))).alias("w")).select(
        *[F.col("w")[j]["weight"].alias(f"w{j}") for j in range(6)])))


def q_huber_mean_gradient(spark, sf):
    """Mean Huber loss and gradient of D1, by column expressions."""
    return rounded(linalg.mean_loss_gradient(price_design(spark, sf), W_PRICE, Huber(1000.0)))


def q_sparse_fit(spark, sf):
    """The accelerated fit on packed sparse rows of D3."""
    cells, labels = event_cells(spark, sf)
    cfg = FitConfig(max_iter=CELL_FIT_ITERS, L0=10.0, convergence_test=False, backtrack_order="reference",
                    layout="sparse", columns=EVENT_COLUMNS)
    return rounded(fit_accelerated(None, LAMBDA_EVENTS, cfg, cells=cells, labels=labels).coefficients(spark))


def q_centred_fit(spark, sf):
    """A linear map plug-in, D2 with its column means taken off inside the map."""
    d = embedding_design(spark, sf)
    n = d.count()
    means = linalg.vector_np(linalg.transpose_product(d.withColumn("one", F.lit(1.0 / n)), "one"), 64, "value")
    cfg = FitConfig(max_iter=CELL_FIT_ITERS, L0=10.0, convergence_test=False, backtrack_order="reference",
                    linear_map=CentredMap(means))
    return rounded(fit_accelerated(d, LAMBDA_EMB, cfg).coefficients(spark))


def q_column_block_fit(spark, sf):
    """The fit of D2 in column blocks, no vector of length p in a task."""
    cfg = FitConfig(max_iter=CELL_FIT_ITERS, L0=10.0, convergence_test=False, backtrack_order="reference")
    dense = DenseEvaluator(embedding_design(spark, sf))
    ev = ColumnBlockEvaluator(dense.df, dense.n, dense.p, column_block=24)
    dense.close()
    try:
        return rounded(fit_accelerated(None, LAMBDA_EMB, cfg, evaluator=ev).coefficients(spark))
    finally:
        ev.close()


def q_bad_loss_fit(spark, sf):
    """A gradient descent whose step makes the loss overflow."""
    cfg = FitConfig(max_iter=GD_ITERS, convergence_test=False, step_size=BAD_STEP)
    r = fit_gradient_descent(_normalised_price(spark, sf), LAMBDA_PRICE, cfg)
    return rounded(r.history_table(spark).select("iteration", F.log10("objective").alias("digits"))
                   .withColumn("status", F.lit(r.status)))


def q_price_residual(spark, sf):
    """Residuals of D1 by the position of the line in its source."""
    r = linalg.residuals(price_design(spark, sf, row_ids=True), W_PRICE)
    return r.select("row_id", *[F.round(F.col(c) * 100).cast("bigint").alias(f"{c}_cents") for c in ("label", "residual")])


def q_align_positions(spark, sf):
    """Labels and features of D2 paired by position, no key."""
    d = embedding_design(spark, sf)
    both = dsg.align_positions(d.select("label"), d.select("features"))
    sums = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return rounded(both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(sums).alias("total")))


def q_row_vectors(spark, sf):
    """O18/O24/O26 over distributed row vectors of D2: r = A w - b / 2 and its products."""
    blocks = vectors.row_blocks(embedding_design(spark, sf))
    b, a = vectors.labels_vector(blocks), vectors.product(blocks, W_EMB)
    r = vectors.combined(a, 1.0, b, -0.5)
    g = vectors.adjoint_product(blocks, r)
    both = vectors.dot(r, a).crossJoin(vectors.dot(r, r).select(F.col("inner_product").alias("square")))  # one row each
    return rounded(g.join(both))


def q_result_folder(spark, sf):
    """Histories of two methods written below a folder, read in one scan."""
    folder = unique_path(spark, "results")
    gd, fused = _both_fits(spark, sf)
    for name, r in (("gd", gd), ("fused", fused)):
        _write_numbers(spark, r, f"{folder}/{name}.csv.{r.n}-{r.p}")
    return rounded(res.read_result_folder(spark, folder, "objective"))


QUERIES = {
    "column_norms": q_column_norms,
    "column_norms_price": q_column_norms_price,
    "normalized_cells": q_normalized_cells,
    "scaled_rows": q_scaled_rows,
    "predict": q_predict,
    "residual": q_residual,
    "combine": q_combine,
    "combine_vectors": q_combine_vectors,
    "inner_product": q_inner_product,
    "inner_product_vectors": q_inner_product_vectors,
    "squared_error": q_squared_error,
    "transpose_product": q_transpose_product,
    "mean_loss_gradient": q_mean_loss_gradient,
    "loss_gradient": q_loss_gradient,
    "soft_threshold": q_soft_threshold,
    "prox_step": q_prox_step,
    "l1_penalty": q_l1_penalty,
    "objective": q_objective,
    "cell_norms": q_cell_norms,
    "cell_normalized": q_cell_normalized,
    "cell_predict": q_cell_predict,
    "cell_transpose_product": q_cell_transpose_product,
    "cell_fit": q_cell_fit,
    "signal_power": q_signal_power,
    "penalty_level": q_penalty_level,
    "align_counts": q_align_counts,
    "row_count": q_row_count,
    "peek": q_peek,
    "design_roundtrip": q_design_roundtrip,
    "gradient_descent": q_gradient_descent,
    "gradient_descent_history": q_gradient_descent_history,
    "accelerated": q_accelerated,
    "optimality": q_optimality,
    "strategy_agreement": q_strategy_agreement,
    "same_iterations": q_same_iterations,
    "timing_table": q_timing_table,
    "history_roundtrip": q_history_roundtrip,
    "relative_difference": q_relative_difference,
    "rmse": q_rmse,
    "gradient_descent_dense": q_gradient_descent_dense,
    "accelerated_gradient_form": q_accelerated_gradient_form,
    "accelerated_history": q_accelerated_history,
    "history_tail": q_history_tail,
    "no_penalty_restarts": q_no_penalty_restarts,
    "converged_fit": q_converged_fit,
    "align_documents_labels": q_align_documents_labels,
    "read_or_write": q_read_or_write,
    "huber_fit": q_huber_fit,
    "huber_mean_gradient": q_huber_mean_gradient,
    "sparse_fit": q_sparse_fit,
    "centred_fit": q_centred_fit,
    "column_block_fit": q_column_block_fit,
    "bad_loss_fit": q_bad_loss_fit,
    "price_residual": q_price_residual,
    "align_positions": q_align_positions,
    "row_vectors": q_row_vectors,
    "result_folder": q_result_folder,
}


# ------------------------------------------------------------------ oracles
def _norm_sql():
    return _with(D2, C2) + f"""SELECT col_id, {_s('sqrt(sum(value * value))')} AS norm
FROM c2 GROUP BY col_id"""


def _norm_price_sql():
    return _with(D1) + f"""SELECT col_id, {_s('sqrt(sum(value * value))')} AS norm FROM
(SELECT unnest(features) AS value, CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS col_id
 FROM d1) GROUP BY col_id"""


def _normalized_cells_sql():
    return _with(D2, C2, "n2 AS (SELECT col_id, sqrt(sum(value * value)) AS norm FROM c2 GROUP BY col_id)") + \
        f"""SELECT c2.row_id, c2.col_id,
  {_s('CASE WHEN n2.norm <> 0 THEN c2.value / n2.norm ELSE 0.0 END')} AS value
FROM c2 JOIN n2 ON c2.col_id = n2.col_id"""


def _scaled_rows_sql():
    return _with(D2, C2) + f"""SELECT row_id, {_s('label * sqrt((SELECT count(*) FROM d2))')} AS label,
  col_id, {_s('value * sqrt((SELECT count(*) FROM d2))')} AS value FROM c2"""


ORACLES = {
    "column_norms": _norm_sql(),
    "column_norms_price": _norm_price_sql(),
    "normalized_cells": _normalized_cells_sql(),
    "scaled_rows": _scaled_rows_sql(),
    "predict": _with(D2, C2, P2) + f"SELECT row_id, {_s('prediction')} AS prediction FROM p2",
    "residual": _with(D2, C2, P2, R2) + f"SELECT row_id, {_s('residual')} AS residual FROM r2",
    "combine": _with(D2, C2, P2) +
        f"SELECT row_id, {_s('1.0 * prediction + 1000.0 * label')} AS combined FROM p2",
    "combine_vectors": _with(D2, C2, P2, R2, G2,
                             "n2 AS (SELECT col_id, sqrt(sum(value * value)) AS norm FROM c2 GROUP BY col_id)") +
        f"""SELECT coalesce(n2.col_id, g2.col_id) AS col_id,
  {_s('1.0 * coalesce(n2.norm, 0.0) - 0.001 * coalesce(g2.value, 0.0)')} AS weight
FROM n2 FULL OUTER JOIN g2 ON n2.col_id = g2.col_id""",
    "inner_product": f"SELECT {_s('sum(l_quantity * l_extendedprice)')} AS inner_product FROM lineitem",
    "inner_product_vectors": _with(D2, C2, P2, R2, G2,
                                   "n2 AS (SELECT col_id, sqrt(sum(value * value)) AS norm FROM c2 GROUP BY col_id)") +
        f"""SELECT {_s('coalesce(sum(n2.norm * g2.value), 0.0)')} AS inner_product
FROM n2 JOIN g2 ON n2.col_id = g2.col_id""",
    "squared_error": _with(D1, R1) + f"SELECT {_s('sum(r * r) / 2.0')} AS squared_error FROM r1",
    "transpose_product": _with(D2, C2, P2, R2, G2) + f"SELECT col_id, {_s('value')} AS value FROM g2",
    "mean_loss_gradient": _with(D1, R1, C1R) +
        f"""SELECT col_id, {_s('sum(value * r) / count(*)')} AS gradient,
  {_s('sum(r * r) / 2.0 / count(*)')} AS loss, CAST(count(*) AS BIGINT) AS n
FROM c1r GROUP BY col_id""",
    "loss_gradient": _with(D1, R1, C1R) +
        f"""SELECT col_id, {_s('sum(value * r)')} AS gradient,
  {_s('(SELECT sum(r * r) / 2.0 FROM r1)')} AS loss, CAST(count(*) AS BIGINT) AS n
FROM c1r GROUP BY col_id""",
    "soft_threshold": _with(D2, C2) +
        f"""SELECT col_id, {_s('sign(g) * greatest(abs(g) - 50.0, 0.0) + 0.0')} AS weight FROM
(SELECT col_id, sum(value * (0.0 - label)) AS g FROM c2 GROUP BY col_id)""",
    "prox_step": _with(D2, C2, P2, R2, G2) +
        f"""SELECT col_id, {_s('sign(v) * greatest(abs(v) - 1.0 * 0.05, 0.0) + 0.0')} AS weight,
  {_s('1.0 * abs(sign(v) * greatest(abs(v) - 1.0 * 0.05, 0.0) + 0.0)')} AS penalty FROM
(SELECT col_id, (col_id + 1) / 64.0 - 0.05 * value AS v FROM g2)""",
    "l1_penalty": _with(D2, C2) +
        f"""SELECT {_s('0.5 * coalesce(sum(abs(g)), 0.0)')} AS penalty FROM
(SELECT col_id, sum(value * (0.0 - label)) AS g FROM c2 GROUP BY col_id)""",
    "objective": _with(D2, C2, P2, R2) +
        f"""SELECT {_s('loss')} AS loss, {_s('penalty')} AS penalty, {_s('loss + penalty')} AS objective
FROM (SELECT sum(residual * residual) / 2.0 AS loss FROM r2),
     (SELECT {LAMBDA_EMB} * sum(abs((j + 1) / 64.0)) AS penalty FROM range(64) t(j))""",
    "signal_power": _with(D1) +
        f"""SELECT {_s('sqrt(sum(label * label))')} AS norm2, {_s('avg(label * label)')} AS mean_square,
  CAST(count(*) AS BIGINT) AS n FROM d1""",
    "penalty_level": _with(D1) +
        f"""SELECT {_s('sqrt(sum(label * label) / 6.0) * power(10, -1.5)')} AS sigma,
  {_s('2.0 * sqrt(sum(label * label) / 6.0) * power(10, -1.5) * ' + repr(math.sqrt(2.0 * math.log(6))))} AS lambda
FROM d1""",
    "align_counts": _with(D2) +
        "SELECT CAST(count(*) AS BIGINT) AS n_joined, CAST(sum(len(features)) AS BIGINT) AS n_cells FROM d2",
    "row_count": "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey",
    "peek": _with(D2) +
        f"""SELECT row_id, {_s('label')} AS label, CAST(len(features) AS INTEGER) AS n_features
FROM d2 ORDER BY row_id LIMIT 10""",
    "design_roundtrip": _with(D2) +
        f"""SELECT row_id, {_s('label')} AS label,
  {_s('list_sum(list_transform(features, lambda v: v * v))')} AS sum_sq FROM d2""",
}


# Normal matrix of the normalised price design (label in thousands): G, c, bb.
NORMAL = D1.replace("CAST(l_extendedprice AS DOUBLE) AS label",
                    f"CAST(l_extendedprice AS DOUBLE) / {LABEL_UNIT} AS label") + """,
raw AS (SELECT a.i, b.j, sum(features[a.i] * features[b.j]) AS g
  FROM d1, range(1, 7) a(i), range(1, 7) b(j) GROUP BY a.i, b.j),
nrm AS (SELECT i, sqrt(g) AS n FROM raw WHERE i = j),
gn AS (SELECT raw.i, raw.j,
    CASE WHEN ni.n <> 0 AND nj.n <> 0 THEN raw.g / (ni.n * nj.n) ELSE 0.0 END AS g
  FROM raw JOIN nrm ni ON raw.i = ni.i JOIN nrm nj ON raw.j = nj.i),
gm AS (SELECT list(rw ORDER BY i) AS G FROM (SELECT i, list(g ORDER BY j) AS rw FROM gn GROUP BY i)),
cv AS (SELECT list(cc ORDER BY i) AS c FROM
  (SELECT a.i, CASE WHEN nrm.n <> 0 THEN sum(features[a.i] * label) / nrm.n ELSE 0.0 END AS cc
   FROM d1, range(1, 7) a(i), nrm WHERE nrm.i = a.i GROUP BY a.i, nrm.n)),
bb AS (SELECT sum(label * label) AS bb FROM d1)"""

_T = "(0.1 / sqrt(k + 1))"
_V = f"(x[i] - {_T} * (list_dot_product(G[i], x) - c[i]))"
GD_CTE = "WITH RECURSIVE " + NORMAL + f""",
it(k, x) AS (
  SELECT 0, [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[]
  UNION ALL
  SELECT k + 1, list_transform(range(1, 7), lambda i:
      sign({_V}) * greatest(abs({_V}) - {LAMBDA_PRICE} * {_T}, 0.0) + 0.0)
  FROM it, gm, cv WHERE k < {GD_ITERS})
"""
OBJ = (f"0.5 * list_sum(list_transform(range(1, 7), lambda i: x[i] * list_dot_product(G[i], x)))"
       f" - list_dot_product(c, x) + 0.5 * bb"
       f" + {LAMBDA_PRICE} * list_sum(list_transform(x, lambda v: abs(v)))")

ORACLES["gradient_descent"] = GD_CTE + f"""SELECT CAST(j AS INTEGER) AS col_id, {sig('x[j + 1]')} AS weight
FROM it, range(0, 6) r(j) WHERE k = {GD_ITERS}"""
ORACLES["gradient_descent_history"] = GD_CTE + f"""SELECT CAST(k + 1 AS INTEGER) AS iteration,
  {sig(OBJ)} AS objective FROM it, gm, cv, bb WHERE k < {GD_ITERS}"""
ORACLES["history_roundtrip"] = GD_CTE + f"""SELECT 'gd' AS method, CAST(k + 1 AS INTEGER) AS iteration,
  {sig(OBJ)} AS objective FROM it, gm, cv, bb WHERE k < {GD_ITERS}"""


def _lt(body: str, p: int = 6) -> str:
    return f"list_transform(range(1, {p + 1}), lambda i: {body})"


def _quad(v: str, p: int = 6) -> str:
    """v^T G v for a p-list v."""
    return f"list_dot_product({v}, {_lt(f'list_dot_product(G[i], {v})', p)})"


def _loss(v: str, p: int = 6) -> str:
    return f"(0.5 * {_quad(v, p)} - list_dot_product(c, {v}) + 0.5 * bb)"


# Accelerated method (reference backtracking order), one recursion row per
# inner step: (it, x_old, z_old, L_old, theta_old, L, simple).
_ALPHA, _BETA, _L0 = ("CAST(0.9 AS DOUBLE)", "CAST(0.5 AS DOUBLE)", "CAST(10.0 AS DOUBLE)")


def acc_cte(normal: str, p: int, lam: float, iters: int, tol: float = 0.0) -> str:
    """Recursive CTE of the accelerated method over a normal matrix
    (gm.G, cv.c, bb.bb), reference backtracking order, L0 10; with ``tol`` the step
    convergence test ends it (column done)."""
    zeros = "[" + ", ".join(["0.0"] * p) + "]::DOUBLE[]"
    lt = lambda body: _lt(body, p)
    sq = lambda body: f"list_sum({_lt(f'({body}) * ({body})', p)})"
    return "WITH RECURSIVE " + normal + f""",
st(it, xo, zo, lo, tho, l, simple, steps, done) AS (
  SELECT 1, {zeros}, {zeros}, {_L0}, CAST('inf' AS DOUBLE), {_ALPHA} * {_L0}, true, 0, false
  UNION ALL
  SELECT CASE WHEN acc THEN it + 1 ELSE it END,
         CASE WHEN acc THEN x ELSE xo END,
         CASE WHEN acc AND rs THEN x WHEN acc THEN z ELSE zo END,
         CASE WHEN acc THEN l ELSE lo END,
         CASE WHEN acc AND rs THEN CAST('inf' AS DOUBLE) WHEN acc THEN th ELSE tho END,
         CASE WHEN acc THEN {_ALPHA} * l
              WHEN isinf(loc) THEN l / {_BETA} ELSE greatest(loc, loc / {_BETA}) END,
         CASE WHEN acc AND rs THEN true ELSE sn END,
         steps + 1,
         acc AND sqrt({sq('x[i] - xo[i]')}) < {tol} * greatest(sqrt({sq('x[i]')}), 1.0)
  FROM (SELECT *, (q = 0.0 OR loc <= l) AS acc,
               (list_dot_product(gy, {lt('x[i] - xo[i]')}) > 0.0) AS rs,
               CASE WHEN q = 0.0 OR NOT simple THEN simple
                    ELSE abs(fy - fx) >= 1e-10 * greatest(abs(fx), abs(fy)) END AS sn
  FROM (SELECT *, CASE WHEN q = 0.0 THEN 0.0
                       WHEN simple THEN l + 2.0 * greatest(fx - (fy + list_dot_product(xy, gy) + 0.5 * l * q), 0.0) / q
                       ELSE 2.0 * {_quad('xy', p)} / q END AS loc
  FROM (SELECT *, list_dot_product(xy, xy) AS q, {_loss('x', p)} AS fx
  FROM (SELECT *, {lt('x[i] - y[i]')} AS xy
  FROM (SELECT *, {lt('(1.0 - th) * xo[i] + th * z[i]')} AS x
  FROM (SELECT *, {lt(f'sign(zo[i] - stp * gy[i]) * greatest(abs(zo[i] - stp * gy[i]) - CAST({lam} AS DOUBLE) * stp, 0.0) + 0.0')} AS z
  FROM (SELECT *, {lt('list_dot_product(G[i], y) - c[i]')} AS gy, {_loss('y', p)} AS fy, 1.0 / (th * l) AS stp
  FROM (SELECT *, {lt('(1.0 - th) * xo[i] + th * zo[i]')} AS y
  FROM (SELECT st.*, gm.G, cv.c, bb.bb,
               2.0 / (1.0 + sqrt(1.0 + 4.0 * (st.l / st.lo) / (st.tho * st.tho))) AS th
        FROM st, gm, cv, bb WHERE st.it <= {iters} AND NOT st.done AND st.steps < 10000)))))))))
)
"""


ACC_CTE = acc_cte(NORMAL, 6, LAMBDA_PRICE, ACC_ITERS)

# Normal matrix of the embedding design from its cells.
NORMAL_EMB = D2 + ",\n" + C2 + """,
gm AS (SELECT list(rw ORDER BY i) AS G FROM
  (SELECT i, list(g ORDER BY j) AS rw FROM
    (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS g
     FROM c2 a JOIN c2 b ON a.row_id = b.row_id GROUP BY a.col_id, b.col_id) GROUP BY i)),
cv AS (SELECT list(cc ORDER BY col_id) AS c FROM
  (SELECT col_id, sum(value * label) AS cc FROM c2 GROUP BY col_id)),
bb AS (SELECT sum(label * label) AS bb FROM d2)"""
CELL_FIT_ITERS = 10
ORACLES["cell_fit"] = acc_cte(NORMAL_EMB, 64, LAMBDA_EMB, CELL_FIT_ITERS) + \
    f"""SELECT CAST(j AS INTEGER) AS col_id, {sig('xo[j + 1]')} AS weight
FROM st, range(0, 64) r(j) WHERE it = {CELL_FIT_ITERS + 1}"""

ORACLES["accelerated"] = ACC_CTE + f"""SELECT CAST(j AS INTEGER) AS col_id, {sig('xo[j + 1]')} AS weight
FROM st, range(0, 6) r(j) WHERE it = {ACC_ITERS + 1}"""

_GX = "(list_dot_product(G[j + 1], xo) - c[j + 1])"
ORACLES["optimality"] = ACC_CTE + f"""SELECT CAST(j AS INTEGER) AS col_id, {sig('xo[j + 1]')} AS weight,
  {sig(_GX)} AS gradient,
  {sig(f"CASE WHEN xo[j + 1] <> 0.0 THEN abs({_GX} + {LAMBDA_PRICE} * sign(xo[j + 1])) ELSE greatest(abs({_GX}) - {LAMBDA_PRICE}, 0.0) END")} AS residual
FROM st, gm, cv, range(0, 6) r(j) WHERE it = {ACC_ITERS + 1}"""

ORACLES["cell_norms"] = ORACLES["column_norms"]
ORACLES["cell_normalized"] = ORACLES["normalized_cells"]
ORACLES["cell_predict"] = ORACLES["predict"]
ORACLES["cell_transpose_product"] = ORACLES["transpose_product"]

ORACLES["gradient_descent_dense"] = ORACLES["gradient_descent"]
ORACLES["accelerated_gradient_form"] = ORACLES["accelerated"]
# The first row of iteration k + 1 holds what iteration k accepted.
_OBJ_AT = OBJ.replace("x[i]", "xo[i]").replace("G[i], x)", "G[i], xo)").replace("(c, x)", "(c, xo)") \
    .replace("list_transform(x,", "list_transform(xo,")
_FIRST = "SELECT *, row_number() OVER (PARTITION BY it ORDER BY steps) AS place FROM st"
ORACLES["accelerated_history"] = ACC_CTE + f"""SELECT CAST(it - 1 AS INTEGER) AS iteration,
  {sig(_OBJ_AT)} AS objective, {sig('lo')} AS lipschitz
FROM ({_FIRST}), gm, cv, bb WHERE place = 1 AND it > 1"""
ORACLES["history_tail"] = ACC_CTE + f"""SELECT CAST(it - 1 AS INTEGER) AS iteration, {sig(_OBJ_AT)} AS objective
FROM ({_FIRST}), gm, cv, bb WHERE place = 1 AND it > {ACC_ITERS - 4}"""
ORACLES["no_penalty_restarts"] = acc_cte(NORMAL, 6, 0.0, ACC_ITERS) + f"""
SELECT CAST(it - 1 AS INTEGER) AS iteration, {sig(_loss('xo'))} AS objective, isinf(tho) AS restarted
FROM ({_FIRST}), gm, cv, bb WHERE place = 1 AND it > 1"""
ORACLES["converged_fit"] = acc_cte(NORMAL, 6, LAMBDA_PRICE, 100, CONVERGED_TOL) + f"""
SELECT CAST(j AS INTEGER) AS col_id, {sig('xo[j + 1]')} AS weight, CAST(it - 1 AS INTEGER) AS iterations,
  'converged' AS status FROM st, range(0, 6) r(j) WHERE done"""
_BOTH = ACC_CTE.rstrip() + ",\n" + GD_CTE[GD_CTE.index("it(k, x) AS"):].replace("it(k, x)", "gd(k, x)") \
    .replace("FROM it, gm", "FROM gd, gm") + f""",
pair AS (SELECT gd.x[j + 1] AS s, st.xo[j + 1] AS t FROM gd, st, range(0, 6) r(j)
  WHERE gd.k = {GD_ITERS} AND st.it = {ACC_ITERS + 1})
"""
ORACLES["relative_difference"] = _BOTH + f"""SELECT 'gd' AS method,
  {sig('sqrt(sum((t - s) * (t - s))) / sqrt(sum(t * t))')} AS relative_difference FROM pair"""
ORACLES["rmse"] = _BOTH + f"SELECT 'gd' AS method, {sig('sqrt(avg((t - s) * (t - s)))')} AS rmse FROM pair"
ORACLES["same_iterations"] = """SELECT count(*) AS methods, min(k) AS min_iterations, max(k) AS max_iterations,
  count(DISTINCT k) = 1 AS same FROM (SELECT event_type, count(*) AS k FROM events GROUP BY event_type)"""
ORACLES["timing_table"] = f"""SELECT event_type AS method, count(*) AS runs,
  {sig('min(value * 1e6 / 1e6)')} AS min_ms, {sig('median(value * 1e6 / 1e6)')} AS median_ms,
  {sig('avg(value * 1e6 / 1e6)')} AS mean_ms FROM events GROUP BY event_type"""
ORACLES["align_documents_labels"] = """SELECT source, count(*) AS n_joined,
  CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(toxic) AS BIGINT) AS toxic,
  CAST(sum(quality) AS BIGINT) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY source"""
ORACLES["read_or_write"] = _with(D2) + f"""SELECT row_id, {_s('label')} AS label,
  CAST(len(features) AS INTEGER) AS n_features, CAST((SELECT count(*) FROM d2) AS DOUBLE) AS n FROM d2"""

ORACLES["strategy_agreement"] = ACC_CTE + f"""SELECT method, CAST(j AS INTEGER) AS col_id, {sig('xo[j + 1]')} AS weight
FROM st, range(0, 6) r(j), (SELECT unnest(['gradient', 'fused', 'gram']) AS method) WHERE it = {ACC_ITERS + 1}"""


def loss_cte(rows: str, p: int, lam: float, iters: int, value: str, slope: str) -> str:
    """Recursive CTE of the accelerated method over rows hr(f, b), any loss of the
    residual r: ``value`` and ``slope`` are SQL texts with the residual for {{r}}."""
    zeros = "[" + ", ".join(["0.0"] * p) + "]::DOUBLE[]"
    lt = lambda body: _lt(body, p)
    r = lambda v: f"(list_dot_product(f, {v}) - b)"
    val = lambda v: value.replace("{r}", r(v))
    der = lambda v: slope.replace("{r}", r(v))
    sums = ", ".join(f"sum(f[{i}] * {der('y')})" for i in range(1, p + 1))
    head = "it, xo, zo, lo, tho, l, simple, steps, th"
    return "WITH RECURSIVE " + rows + f""",
st(it, xo, zo, lo, tho, l, simple, steps) AS (
  SELECT 1, {zeros}, {zeros}, {_L0}, CAST('inf' AS DOUBLE), {_ALPHA} * {_L0}, true, 0
  UNION ALL
  SELECT CASE WHEN acc THEN it + 1 ELSE it END, CASE WHEN acc THEN x ELSE xo END,
         CASE WHEN acc AND rs THEN x WHEN acc THEN z ELSE zo END, CASE WHEN acc THEN l ELSE lo END,
         CASE WHEN acc AND rs THEN CAST('inf' AS DOUBLE) WHEN acc THEN th ELSE tho END,
         CASE WHEN acc THEN {_ALPHA} * l WHEN isinf(loc) THEN l / {_BETA} ELSE greatest(loc, loc / {_BETA}) END,
         CASE WHEN acc AND rs THEN true ELSE sn END, steps + 1
  FROM (SELECT *, (q = 0.0 OR loc <= l) AS acc, list_dot_product(gy, {lt('x[i] - xo[i]')}) > 0.0 AS rs,
               CASE WHEN q = 0.0 OR NOT simple THEN simple
                    ELSE abs(fy - fx) >= 1e-10 * greatest(abs(fx), abs(fy)) END AS sn
  FROM (SELECT *, CASE WHEN q = 0.0 THEN 0.0
                       WHEN simple THEN l + 2.0 * greatest(fx - (fy + list_dot_product(d, gy) + 0.5 * l * q), 0.0) / q
                       ELSE 2.0 * cu / q END AS loc
  FROM (SELECT {head}, y, fy, gy, z, x, d, list_dot_product(d, d) AS q, sum({val('x')}) AS fx,
               sum(list_dot_product(f, d) * ({der('x')} - {der('y')})) AS cu
  FROM (SELECT *, {lt('x[i] - y[i]')} AS d
  FROM (SELECT *, {lt('(1.0 - th) * xo[i] + th * z[i]')} AS x
  FROM (SELECT *, {lt(f'sign(zo[i] - gy[i] / (th * l)) * greatest(abs(zo[i] - gy[i] / (th * l)) - CAST({lam} AS DOUBLE) / (th * l), 0.0) + 0.0')} AS z
  FROM (SELECT {head}, y, sum({val('y')}) AS fy, [{sums}] AS gy
  FROM (SELECT *, {lt('(1.0 - th) * xo[i] + th * zo[i]')} AS y
  FROM (SELECT st.*, 2.0 / (1.0 + sqrt(1.0 + 4.0 * (l / lo) / (tho * tho))) AS th FROM st WHERE it <= {iters} AND steps < 10000)),
  hr GROUP BY {head}, y)))), hr GROUP BY {head}, y, fy, gy, z, x, d))))
"""


HUBER_VALUE = f"(CASE WHEN abs({{r}}) <= {HUBER_DELTA} THEN {{r}} * {{r}} / 2.0 ELSE {HUBER_DELTA} * (abs({{r}}) - {HUBER_DELTA} / 2.0) END)"
HUBER_SLOPE = f"greatest(least({{r}}, {HUBER_DELTA}), -{HUBER_DELTA})"
HUBER_ROWS = NORMAL[:NORMAL.index(",\nraw AS")] + """,
hn AS (SELECT [""" + ", ".join(f"sqrt(sum(features[{i}] * features[{i}]))" for i in range(1, 7)) + """] AS n FROM d1),
hr AS (SELECT """ + _lt("CASE WHEN n[i] <> 0 THEN features[i] / n[i] ELSE 0.0 END") + """ AS f, label AS b FROM d1, hn)"""
HUBER_CTE = loss_cte(HUBER_ROWS, 6, LAMBDA_HUBER, HUBER_ITERS, HUBER_VALUE, HUBER_SLOPE)
ORACLES["huber_fit"] = HUBER_CTE + f""",
ends AS (SELECT *, row_number() OVER (PARTITION BY it ORDER BY steps) AS place FROM st),
obj AS (SELECT it, lo, xo, sum({HUBER_VALUE.replace('{r}', '(list_dot_product(f, xo) - b)')})
    + {LAMBDA_HUBER} * list_sum(list_transform(xo, lambda v: abs(v))) AS objective
  FROM ends, hr WHERE place = 1 AND it > 1 GROUP BY it, lo, xo),
last AS (SELECT xo AS w FROM obj WHERE it = {HUBER_ITERS + 1})
SELECT CAST(it - 1 AS INTEGER) AS iteration, {sig('objective')} AS objective, {sig('lo')} AS lipschitz,
  """ + ", ".join(f"{sig(f'w[{j + 1}]')} AS w{j}" for j in range(6)) + """ FROM obj, last"""
_HM = HUBER_VALUE.replace(str(HUBER_DELTA), "1000.0").replace("{r}", "r")
ORACLES["huber_mean_gradient"] = _with(D1, R1, C1R) + f"""SELECT col_id,
  {_s('sum(value * greatest(least(r, 1000.0), -1000.0)) / count(*)')} AS gradient,
  {_s(f'sum({_HM}) / count(*)')} AS loss, CAST(count(*) AS BIGINT) AS n FROM c1r GROUP BY col_id"""

NORMAL_EVENTS = f"""types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS place
  FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL)),
c3 AS (SELECT user_id AS row_id, place * {EVENT_SLOTS} + event_id % {EVENT_SLOTS} AS col_id, sum(value) / 1000.0 AS value
  FROM events JOIN types USING (event_type) WHERE user_id IS NOT NULL GROUP BY 1, 2),
l3 AS (SELECT user_id AS row_id, CAST(count(*) AS DOUBLE) AS label FROM events WHERE user_id IS NOT NULL GROUP BY 1),
g3 AS (SELECT a.col_id AS i, b.col_id AS j, sum(a.value * b.value) AS g
  FROM c3 a JOIN c3 b ON a.row_id = b.row_id GROUP BY 1, 2),
s3 AS (SELECT i, j FROM range(0, {EVENT_COLUMNS}) a(i), range(0, {EVENT_COLUMNS}) b(j)),
gm AS (SELECT list(rw ORDER BY i) AS G FROM
  (SELECT i, list(coalesce(g, 0.0) ORDER BY j) AS rw FROM s3 LEFT JOIN g3 USING (i, j) GROUP BY i)),
k3 AS (SELECT col_id AS i, sum(value * label) AS cc FROM c3 JOIN l3 USING (row_id) GROUP BY 1),
cv AS (SELECT list(coalesce(cc, 0.0) ORDER BY i) AS c FROM range(0, {EVENT_COLUMNS}) a(i) LEFT JOIN k3 USING (i)),
bb AS (SELECT sum(label * label) AS bb FROM l3)"""


def _weights_of(normal: str, p: int, lam: float) -> str:
    return acc_cte(normal, p, lam, CELL_FIT_ITERS) + f"""SELECT CAST(j AS INTEGER) AS col_id, {sig('xo[j + 1]')} AS weight
FROM st, range(0, {p}) r(j) WHERE it = {CELL_FIT_ITERS + 1}"""


ORACLES["sparse_fit"] = _weights_of(NORMAL_EVENTS, EVENT_COLUMNS, LAMBDA_EVENTS)
ORACLES["centred_fit"] = _weights_of(NORMAL_EMB.replace(
    C2, C2.replace("c2 AS", "u2 AS") + """,
c2 AS (SELECT row_id, label, col_id, value - avg(value) OVER (PARTITION BY col_id) AS value FROM u2)"""), 64, LAMBDA_EMB)
ORACLES["column_block_fit"] = ORACLES["cell_fit"]
_BAD_LOSS = OBJ[:OBJ.index(f" + {LAMBDA_PRICE} *")]
ORACLES["bad_loss_fit"] = GD_CTE.replace("(0.1 / sqrt(k + 1))", f"({BAD_STEP!r} / sqrt(k + 1))").replace(
    f"WHERE k < {GD_ITERS}", "WHERE k < 6") + f""",
o AS (SELECT k + 1 AS iteration, {OBJ} AS objective, {_BAD_LOSS} AS loss FROM it, gm, cv, bb),
bad AS (SELECT min(iteration) AS ends FROM o WHERE isnan(loss) OR isinf(loss))
SELECT CAST(iteration AS INTEGER) AS iteration, {sig('log10(objective)')} AS digits, 'bad_loss' AS status
FROM o, bad WHERE iteration < ends"""
ORACLES["price_residual"] = f"""WITH li AS (SELECT *, row_number() OVER () - 1 AS row_id FROM lineitem)
SELECT row_id, CAST(round(label * 100) AS BIGINT) AS label_cents, CAST(round((pred - label) * 100) AS BIGINT) AS residual_cents FROM
(SELECT row_id, CAST(l_extendedprice AS DOUBLE) AS label,
        list_dot_product([CAST(l_quantity AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_tax AS DOUBLE),
          CAST(l_linenumber AS DOUBLE), CAST(p_retailprice AS DOUBLE), CAST(p_size AS DOUBLE)], {W_PRICE_SQL}) AS pred
 FROM li JOIN part ON l_partkey = p_partkey)"""
ORACLES["align_positions"] = _with(D2) + f"""SELECT {_s('label')} AS label, count(*) AS n,
  {_s('sum(list_sum(features))')} AS total FROM d2 GROUP BY d2.label"""
ORACLES["row_vectors"] = _with(D2, C2, P2, "v2 AS (SELECT row_id, prediction AS a, prediction - label / 2.0 AS r FROM p2)") + f"""
SELECT col_id, {_s('sum(value * r)')} AS value, {_s('(SELECT sum(r * a) FROM v2)')} AS inner_product,
  (SELECT count(*) FROM v2) AS n, {_s('(SELECT sum(r * r) FROM v2)')} AS square
FROM c2 JOIN v2 ON c2.row_id = v2.row_id GROUP BY col_id"""
_N_PRICE = "(SELECT count(*) FROM d1)"
ORACLES["result_folder"] = _BOTH.replace("pair AS (SELECT gd.x[j + 1] AS s, st.xo[j + 1] AS t FROM gd, st, range(0, 6) r(j)", "unused AS (SELECT 1 AS one FROM gd, st") + f"""
SELECT 'gd' AS method, {_N_PRICE} AS n_rows, CAST(6 AS BIGINT) AS n_cols, CAST(k + 1 AS INTEGER) AS iteration,
  {sig(OBJ)} AS objective FROM gd, gm, cv, bb WHERE k < {GD_ITERS}
UNION ALL SELECT 'fused', {_N_PRICE}, 6, CAST(it - 1 AS INTEGER), {sig(_OBJ_AT)}
FROM ({_FIRST}), gm, cv, bb WHERE place = 1 AND it > 1"""
