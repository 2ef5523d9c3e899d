"""Single-pass operators over design tables (O14-O30, O45-O46 helpers).

Each returns a DataFrame and stays a Catalyst plan: SQL forms (posexplode +
group by column, literal arrays) for narrow designs, Arrow passes with a
broadcast vector for wide ones. Vector tables are ``(col_id INT, <value>)``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penfit.functions.columns import (MAX_LITERAL_ARRAY, array_dot, array_scale, divide_by,
                                      soft_threshold)
from penfit.functions.loss import SquaredError
from penfit.operators import passes
from penfit.sources.design import NARROW, WIDTH, known_width


def exploded(design: DataFrame, *extra: str) -> DataFrame:
    """(col_id, value, extra...) per design cell; the partial aggregate that
    usually follows runs in the same stage, so each task sends p rows."""
    return design.select(*extra, F.posexplode("features").alias("col_id", "value")) \
        .withColumn("col_id", F.col("col_id").cast("int"))


def column_norms(design: DataFrame) -> DataFrame:
    """(col_id, norm) = 2-norm of every feature column; one scan, one partial
    vector a task. A design of a few known columns is summed in SQL."""
    p = known_width(design)
    if p is not None and 1 <= p <= NARROW:
        stop = F.raise_error(F.lit(f"feature arrays must all have length {p}, without nulls")).cast("double")
        held = F.coalesce(F.size("features"), F.lit(-1)) == p
        sums = [F.when(held & F.col("features")[i].isNotNull(), F.col("features")[i] * F.col("features")[i])
                .otherwise(stop) for i in range(p)]
        one = design.agg(F.count(F.lit(1)).alias("n"), *[F.sqrt(F.sum(v)).alias(str(i)) for i, v in enumerate(sums)])
        long = one.where("n > 0").unpivot(["n"], [str(i) for i in range(p)], "col_id", "norm")
        return long.select(F.col("col_id").cast("int").alias("col_id"), "norm")
    return passes.column_table(design, lambda M: (np.einsum("ij,ij->j", M, M), 0.0), "norm double",
                               lambda _, sums: [np.sqrt(sums)])


def vector_np(table: DataFrame, p: int, value: str, key: str = "col_id") -> np.ndarray:
    """A (col_id, value) table of at most p rows -> dense NumPy vector."""
    pdf = table.select(key, value).toPandas()
    out = np.zeros(p)
    out[pdf[key].to_numpy(dtype=np.int64)] = pdf[value].to_numpy(dtype=np.float64)
    return out


def vector_table(spark: SparkSession, v, value: str = "weight") -> DataFrame:
    """Dense NumPy vector -> (col_id INT, value DOUBLE)."""
    import pandas as pd
    v = np.asarray(v, dtype=np.float64).ravel()
    return spark.createDataFrame(pd.DataFrame({"col_id": np.arange(len(v), dtype=np.int32),
                                               value: v}),
                                 T.StructType([T.StructField("col_id", T.IntegerType(), False),
                                               T.StructField(value, T.DoubleType(), False)]))


def _map_features(design: DataFrame, fn_np, literal_col_fn, vec: np.ndarray) -> DataFrame:
    """Apply a per-row feature transform with a p-length vector: literal
    arrays in SQL for narrow designs, a broadcast + Arrow for wide ones."""
    if len(vec) <= MAX_LITERAL_ARRAY:
        return design.withColumn("features", literal_col_fn(vec).alias("features", metadata={WIDTH: len(vec)}))
    import pyarrow as pa
    from penfit.session import ship_package
    ship_package(design.sparkSession)
    bc = design.sparkSession.sparkContext.broadcast(vec)
    names = design.columns
    fidx = names.index("features")
    p = len(vec)

    def task(it):
        v = bc.value
        for b in it:
            M = fn_np(passes.features_matrix(b.column(fidx), p), v)
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, M.size + 1, p, dtype=np.int32)),
                                           pa.array(M.ravel(), pa.float64()))
            cols = list(b.columns)
            cols[fidx] = arr
            yield pa.RecordBatch.from_arrays(cols, names=list(b.schema.names))

    return design.mapInArrow(task, design.schema)


def normalize_columns(design: DataFrame, norms: np.ndarray | None = None) -> DataFrame:
    """Every feature divided by its column 2-norm; zero columns stay 0."""
    if norms is None:
        held = column_norms(design).toPandas()  # p rows; their number is the width
        norms = np.zeros(len(held))
        norms[held["col_id"].to_numpy()] = held["norm"].to_numpy()
    norms = np.asarray(norms, dtype=np.float64)

    def np_fn(M, v):
        safe = np.where(v != 0.0, v, 1.0)
        return np.where(v != 0.0, M / safe, 0.0)

    return _map_features(design, np_fn, lambda v: divide_by("features", list(v)), norms)


def scale_rows(design: DataFrame, c: float) -> DataFrame:
    """Label and features times c."""
    return design.withColumn("label", F.col("label") * F.lit(float(c))) \
        .withColumn("features", array_scale("features", c))


def predict(design: DataFrame, w, out: str = "prediction") -> DataFrame:
    """A.w as a column."""
    w = np.asarray(w, dtype=np.float64).ravel()
    if len(w) <= 64:
        return design.withColumn(out, array_dot("features", list(w)))
    return passes.predict(design, w, out=out)


def residuals(design: DataFrame, w, out: str = "residual") -> DataFrame:
    """Prediction - label."""
    return predict(design, w).withColumn(out, F.col("prediction") - F.col("label"))


def combine_vectors(a: DataFrame, alpha: float, b: DataFrame, beta: float,
                    value: str = "weight", key: str = "col_id") -> DataFrame:
    """O18 for two vector tables: full outer join on col_id, missing = 0."""
    return (a.select(key, F.col(value).alias("_a"))
            .join(b.select(key, F.col(value).alias("_b")), key, "full_outer")
            .select(key, (F.lit(float(alpha)) * F.coalesce("_a", F.lit(0.0))
                          + F.lit(float(beta)) * F.coalesce("_b", F.lit(0.0))).alias(value)))


def inner_product(df: DataFrame, a: str, b: str, out: str = "inner_product") -> DataFrame:
    """sum(a*b) over rows of one table."""
    return df.agg(F.sum(F.col(a) * F.col(b)).alias(out))


def inner_product_vectors(a: DataFrame, b: DataFrame, value_a: str = "weight",
                          value_b: str = "weight", key: str = "col_id",
                          out: str = "inner_product") -> DataFrame:
    """O24 for vector tables: join on col_id, then sum; absent entries are 0."""
    return (a.select(key, F.col(value_a).alias("_a"))
            .join(b.select(key, F.col(value_b).alias("_b")), key, "inner")
            .agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0.0)).alias(out)))


def squared_error(df: DataFrame, r: str = "residual", out: str = "squared_error",
                  loss=SquaredError) -> DataFrame:
    """Sum of the loss over rows, r^2/2 for squared error (sum, not mean)."""
    return df.agg(F.sum(loss.value_col(F.col(r))).alias(out))


def transpose_product(df: DataFrame, r: str = "residual", out: str = "value") -> DataFrame:
    """A^T r as (col_id, value); one scan, one partial vector a task."""
    return passes.column_table(df, lambda M, v: (M.T @ v, 0.0), f"{out} double", lambda _, sums: [sums],
                               columns=("features", r))


def mean_loss_gradient(design: DataFrame, w, loss=SquaredError) -> DataFrame:
    """Mean loss and mean gradient at w, one row per column: (col_id, gradient,
    loss, n). The residual is a column of the scan; the loss plug-in (O42) gives its
    value and derivative per row, summed once per task."""
    res = residuals(design, w).withColumn("_d", loss.derivative_col(F.col("residual"))) \
        .withColumn("_l", loss.value_col(F.col("residual")))

    def made(scalars, sums):
        total, n = scalars
        return [sums / n, np.full(len(sums), total / n), np.full(len(sums), int(round(n)), np.int64)]

    return passes.column_table(
        res, lambda M, d, v: (M.T @ d, np.array([v.sum(), float(len(v))])),
        "gradient double, loss double, n bigint", made, scalars=2, columns=("features", "_d", "_l"))


def loss_and_gradient(design: DataFrame, w, p: int | None = None, average: bool = False):
    """O27/O28, fused Arrow form: one scan -> (loss, gradient, n) on the
    driver (p-length)."""
    w = np.asarray(w, dtype=np.float64).ravel()
    r = passes.multi_pass(design, len(w), w.reshape(-1, 1), [True], [0])
    scale = 1.0 / r.n if average else 1.0
    return float(r.losses[0]) * scale, r.grads[:, 0] * scale, r.n


def signal_power(df: DataFrame, col: str = "label") -> DataFrame:
    """2-norm and mean square of one column, no collect."""
    return df.agg(F.sqrt(F.sum(F.col(col) * F.col(col))).alias("norm2"),
                  F.avg(F.col(col) * F.col(col)).alias("mean_square"),
                  F.count(F.lit(1)).alias("n"))


def penalty_level(df: DataFrame, p: int, col: str = "label", snr_db: float = 30.0) -> DataFrame:
    """sigma = sqrt(||b0||^2 / p) * 10^(-snr/20); lambda = 2 sigma sqrt(2 ln p).
    Divides by the number of columns p, as the generator does."""
    f = 10.0 ** (-snr_db / 20.0)
    ss = F.sum(F.col(col) * F.col(col))
    sigma = F.sqrt(ss / F.lit(float(p))) * F.lit(f)
    return df.agg(sigma.alias("sigma"),
                  (F.lit(2.0) * sigma * F.lit(math.sqrt(2.0 * math.log(p)))).alias("lambda"))


def l1_penalty(weights: DataFrame, lam: float, value: str = "weight",
               out: str = "penalty") -> DataFrame:
    """Lam * sum(|w|)."""
    return weights.agg((F.lit(float(lam)) * F.coalesce(F.sum(F.abs(value)), F.lit(0.0)))
                       .alias(out))


def soft_threshold_table(weights: DataFrame, t: float, value: str = "weight") -> DataFrame:
    """O19 over a vector table."""
    return weights.select("col_id", soft_threshold(value, t).alias(value))


def prox_step(weights: DataFrame, gradient: DataFrame, step: float, iteration: int,
              lam: float, value: str = "weight", grad: str = "gradient") -> DataFrame:
    """t = step / sqrt(iteration); w - t g, soft-thresholded by lam t.
    Output (col_id, weight, penalty) where penalty = lam * |new weight|."""
    t = float(step) / math.sqrt(iteration)
    moved = (weights.select("col_id", F.col(value).alias("_w"))
             .join(gradient.select("col_id", F.col(grad).alias("_g")), "col_id", "full_outer")
             .select("col_id", (F.coalesce("_w", F.lit(0.0)) - F.lit(t) * F.coalesce("_g", F.lit(0.0)))
                     .alias("_v")))
    new_w = soft_threshold("_v", lam * t)
    return moved.select("col_id", new_w.alias(value),
                        (F.lit(float(lam)) * F.abs(new_w)).alias("penalty"))


# ------------------------------------------------------------- cell layout
# Cells are (row_id, col_id, value); labels are (row_id, label). Vector
# tables join on col_id without a hint: Spark broadcasts one when its measured size is
# under the session's bound, else it shuffles (AQE splits a hot col_id). With a
# known p the bound is MAX_BROADCAST_BYTES.

def _small(table: DataFrame, p: int | None) -> DataFrame:
    return F.broadcast(table) if p is not None and 16 * p <= passes.MAX_BROADCAST_BYTES else table


def column_norms_cells(cells: DataFrame) -> DataFrame:
    """O20, cell layout: (col_id, norm)."""
    return cells.groupBy("col_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value")))
                                       .alias("norm"))


def normalize_cells(cells: DataFrame, norms: DataFrame | None = None,
                    p: int | None = None) -> DataFrame:
    """O14, cell layout: value / norm of its column (0 for a zero column)."""
    norms = norms if norms is not None else column_norms_cells(cells)
    return (cells.join(_small(norms, p), "col_id")
            .select("row_id", "col_id",
                    F.when(F.col("norm") != 0.0, F.col("value") / F.col("norm"))
                    .otherwise(F.lit(0.0)).alias("value")))


def predict_cells(cells: DataFrame, labels: DataFrame, weights: DataFrame,
                  value: str = "weight", p: int | None = None) -> DataFrame:
    """O16, cell layout: (row_id, label, prediction); rows without cells
    predict 0 (left join from the labels). ``p`` is the number of weights, if known."""
    pred = (cells.join(_small(weights.select("col_id", value), p), "col_id")
            .groupBy("row_id").agg(F.sum(F.col("value") * F.col(value)).alias("prediction")))
    return (labels.join(pred, "row_id", "left")
            .select("row_id", "label", F.coalesce("prediction", F.lit(0.0)).alias("prediction")))


def transpose_product_cells(cells: DataFrame, rows: DataFrame, r: str = "residual",
                            out: str = "value") -> DataFrame:
    """O26, cell layout: A^T r as (col_id, value); ``rows`` holds (row_id, r)."""
    return (cells.join(rows.select("row_id", r), "row_id")
            .groupBy("col_id").agg(F.sum(F.col("value") * F.col(r)).alias(out)))


def objective(design: DataFrame, w, lam: float) -> DataFrame:
    """Smooth value at w plus the L1 penalty at w, one row
    (loss, penalty, objective)."""
    w = np.asarray(w, dtype=np.float64).ravel()
    pen = float(lam) * float(np.abs(w).sum())
    loss = squared_error(residuals(design, w), out="loss")
    return loss.select("loss", F.lit(pen).alias("penalty"),
                       (F.col("loss") + F.lit(pen)).alias("objective"))
