"""Synthetic sparse-regression data.

Every random number is a function of (seed, row_id[, col_id]), so a row is
the same under any partitioning and after any task retry; the reference's
unseeded weight shuffle and per-partition repeated noise are not kept.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penfit.operators import passes
from penfit.operators.linalg import vector_np

# Fixed values of the published benchmark data: seed 92, signal-to-noise
# 30 dB, one tenth of the true weights nonzero.
DEFAULT_SEED = 92
DEFAULT_SNR_DB = 30.0
DEFAULT_FRACTION = 0.1

_TWO53 = float(2 ** 53)


def from_range(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Row ids 0..n-1 in ``partitions`` slices (default: 3 per core)."""
    partitions = partitions or max(1, 3 * spark.sparkContext.defaultParallelism)
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "row_id")


def gaussian_rows(row_ids: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row r of the Gaussian design: ``default_rng([seed, r]).standard_normal(p)``."""
    M = np.empty((len(row_ids), p))
    for i, r in enumerate(row_ids):
        M[i] = np.random.default_rng([seed, int(r)]).standard_normal(p)
    return M


def _list_column(M: np.ndarray, p: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, M.size + 1, p, dtype=np.int32)),
                                    pa.array(M.ravel()))


def gaussian_design(spark: SparkSession, n: int, p: int, seed: int = DEFAULT_SEED,
                    partitions: int | None = None) -> DataFrame:
    """N rows of p standard normals, ``(row_id, features)``. Row r draws
    from ``numpy.random.default_rng([seed, r])``."""
    from penfit.session import ship_package
    ship_package(spark)
    ids = from_range(spark, n, partitions)

    def task(it):
        for b in it:
            M = gaussian_rows(b.column(0).to_numpy(), p, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), _list_column(M, p)],
                                             names=["row_id", "features"])

    return ids.mapInArrow(task, "row_id bigint, features array<double>")


def hash_uniform(*cols) -> "F.Column":
    """Uniform in (0, 1) from xxhash64 of the arguments: top 53 bits + 1/2."""
    h = F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")
    return (h + F.lit(0.5)) / F.lit(_TWO53)


def hash_normal(seed: int, key, stream: int = 0) -> "F.Column":
    """Standard normal from a key by Box-Muller over two hash uniforms."""
    u1 = hash_uniform(F.lit(seed), key, F.lit(2 * stream))
    u2 = hash_uniform(F.lit(seed), key, F.lit(2 * stream + 1))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def sparse_weights(spark: SparkSession, p: int, fraction: float = DEFAULT_FRACTION,
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """``(col_id, weight)``: int(p * fraction) columns chosen by the lowest
    hash rank get a normal weight, the others 0.0. Deterministic in seed."""
    k = int(p * fraction) if fraction != DEFAULT_FRACTION else p // 10
    cols = spark.range(0, p).select(F.col("id").cast("int").alias("col_id"))
    ranked = cols.withColumn("_h", F.xxhash64(F.lit(seed), F.col("col_id"), F.lit(-1)))
    chosen = ranked.orderBy("_h", "col_id").limit(k).select("col_id", F.lit(True).alias("_on"))
    return (cols.join(chosen, "col_id", "left")
            .select("col_id", F.when(F.col("_on"), hash_normal(seed, F.col("col_id"), 7))
                    .otherwise(F.lit(0.0)).alias("weight")))


def noise_term(mean_square: float, snr_db: float = DEFAULT_SNR_DB) -> float:
    """10^((10 log10(mean b0^2) - snr)/20) = sqrt(mean b0^2) 10^(-snr/20)."""
    return math.sqrt(mean_square) * 10.0 ** (-snr_db / 20.0)


def add_noise(df: DataFrame, term: float, seed: int = DEFAULT_SEED, col: str = "b0",
              out: str = "label") -> DataFrame:
    """label = b0 + term * N(0,1), the normal drawn from hash(seed, row_id)."""
    return df.withColumn(out, F.col(col) + F.lit(float(term)) *
                         hash_normal(seed, F.col("row_id"), 3))


def lambda_from_signal(sum_sq: float, p: int, snr_db: float = DEFAULT_SNR_DB) -> float:
    """O11 closed form: 2 sigma sqrt(2 ln p), sigma = sqrt(sum b0^2 / p) 10^(-snr/20)."""
    sigma = math.sqrt(sum_sq / p) * 10.0 ** (-snr_db / 20.0)
    return 2.0 * sigma * math.sqrt(2.0 * math.log(p)) if p > 1 else 0.0


def make_lasso_data(spark: SparkSession, n: int, p: int, seed: int = DEFAULT_SEED,
                    snr_db: float = DEFAULT_SNR_DB, fraction: float = DEFAULT_FRACTION,
                    partitions: int | None = None):
    """Gaussian design, unit-norm columns, sparse true weights, 30 dB
    noise, penalty level. Returns (design, lambda, true_weights_table, normed).

    Two Python passes over row ids; rows are generated inside the tasks and
    never shipped to them: (1) per-column sums of squares of the Gaussian
    rows (task partials only), (2) the rows again, divided by the column
    norms, with b0 = row . w (true weights broadcast) -> ``normed``
    (row_id, b0, features), persisted. Signal power is one JVM aggregate over
    it; noise is a JVM column expression. The caller writes ``design``
    (write_design) and then unpersists ``normed``.
    """
    from penfit.session import ship_package
    ship_package(spark)
    ids = from_range(spark, n, partitions)
    tasks = ids.rdd.getNumPartitions()

    def sumsq_task(it):
        acc = np.zeros(p)
        seen = 0
        for b in it:
            if b.num_rows:
                M = gaussian_rows(b.column(0).to_numpy(), p, seed)
                acc += np.einsum("ij,ij->j", M, M)
                seen += b.num_rows
        if seen:
            yield passes.emit_blocks(acc)

    norms = np.sqrt(passes.sum_blocks(ids.mapInArrow(sumsq_task, passes.PARTIAL_SCHEMA), p,
                                      tasks))
    wt = sparse_weights(spark, p, fraction, seed)
    w = vector_np(wt, p, "weight")
    sc = spark.sparkContext
    bc = sc.broadcast(np.vstack([np.where(norms != 0.0, norms, 1.0), (norms != 0.0), w]))

    def normed_task(it):
        passes.single_thread_blas()
        nv, nz, wv = bc.value
        for b in it:
            M = np.where(nz, gaussian_rows(b.column(0).to_numpy(), p, seed) / nv, 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(M @ wv), _list_column(M, p)],
                                             names=["row_id", "b0", "features"])

    normed = ids.mapInArrow(normed_task, "row_id bigint, b0 double, features array<double>") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    stats = normed.agg(F.sum(F.col("b0") * F.col("b0")).alias("ss"),
                       F.avg(F.col("b0") * F.col("b0")).alias("ms")).first()
    term = noise_term(stats["ms"], snr_db)
    lam = lambda_from_signal(stats["ss"], p, snr_db)
    design = add_noise(normed, term, seed).select("row_id", "label", "features")
    return design, lam, wt, normed


def read_or_make_lasso(spark: SparkSession, design_path: str, param_path: str, n: int, p: int,
                       seed: int = DEFAULT_SEED, snr_db: float = DEFAULT_SNR_DB,
                       fraction: float = DEFAULT_FRACTION, partitions: int | None = None):
    """O3 with O12: read the stored design and its penalty level; only when
    the design path is missing, generate both, write them and read back.
    Returns (design, lambda)."""
    from penfit.sources.design import read_or_generate, read_param
    made = {}

    def generate():
        design, lam, _, normed = make_lasso_data(spark, n, p, seed, snr_db, fraction, partitions)
        made["lam"], made["normed"] = lam, normed
        return design

    try:
        design = read_or_generate(spark, design_path, generate, param_path,
                                  lambda: made["lam"])
    finally:
        if "normed" in made:
            made["normed"].unpersist()
    return design, read_param(spark, param_path, "lambda")
