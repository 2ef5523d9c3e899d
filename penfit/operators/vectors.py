"""Distributed row vectors (O18, O24 over row vectors; J1): a vector with one number
per design row, kept as blocks next to the design's blocks.

``row_blocks`` packs a design into blocks (rb, rows, labels, features), partitioned by
the block number rb; a row vector is a table (rb, v) of the same blocks, v the numbers
of the block's rows. Vectors of one design share its partitioning, so combining them
(column expressions, however many one after the other), their inner product and
products with the matrix move no row: the joins by rb need no exchange.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penfit.operators import passes
from penfit.operators.maps import MatrixMap

VECTOR = "rb bigint, v array<double>"


def row_blocks(design: DataFrame, partitions: int | None = None) -> DataFrame:
    """(rb, rows, labels, features), persisted, partitioned by rb. Block numbers and rows
    are written to the checkpoint folder first, so that they belong together for good.
    The caller unpersists it."""
    from penfit.session import ensure_checkpoint_dir
    spark = design.sparkSession
    ensure_checkpoint_dir(spark)
    blocks = passes.blockify(design)
    numbered = blocks.select(F.monotonically_increasing_id().alias("rb"), *blocks.columns).checkpoint(eager=True)
    parts = partitions or spark.sparkContext.defaultParallelism
    return numbered.repartition(parts, "rb").persist(StorageLevel.MEMORY_AND_DISK)


def _doubles(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<f8")


def _batch(rb, vectors):
    import pyarrow as pa
    ends = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int32)
    values = np.concatenate(vectors) if vectors else np.empty(0)
    return pa.RecordBatch.from_arrays([rb, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["rb", "v"])


def labels_vector(blocks: DataFrame) -> DataFrame:
    """b as a row vector."""
    def task(it):
        for b in it:
            yield _batch(b.column(0), [_doubles(y) for y in b.column(1)])

    return _kept(blocks, blocks.select("rb", "labels").mapInArrow(task, VECTOR))


def product(blocks: DataFrame, w, linear_map=None) -> DataFrame:
    """A w as a row vector; the coefficients travel as one broadcast."""
    m = linear_map if linear_map is not None else MatrixMap()
    w = np.asarray(w, dtype=np.float64).ravel()
    passes._check_broadcast(w.nbytes)
    bc, raw = blocks.sparkSession.sparkContext.broadcast(w), m.raw_width(len(w))

    def task(it):
        passes.single_thread_blas()
        for b in it:
            yield _batch(b.column(0), [m.apply(_doubles(f).reshape(n, raw), bc.value[:, None])[:, 0]
                                       for n, f in zip(b.column(1).to_pylist(), b.column(2))])

    return _kept(blocks, blocks.select("rb", "rows", "features").mapInArrow(task, VECTOR))


def _kept(blocks: DataFrame, vector: DataFrame) -> DataFrame:
    """The vector behind the blocks' rows, so that Spark knows its partitioning: an
    Arrow stage hides it, a repartition by rb into as many parts restores it. Only row
    vectors (8 bytes a row) move, once, when they are made."""
    return vector.repartition(blocks.rdd.getNumPartitions(), "rb").persist(StorageLevel.MEMORY_AND_DISK)


def combined(a: DataFrame, alpha: float, b: DataFrame, beta: float) -> DataFrame:
    """alpha a + beta b of two row vectors of one design, no exchange."""
    return _pairs(a, b).select("rb", F.zip_with(
        "x", "y", lambda x, y: F.lit(float(alpha)) * x + F.lit(float(beta)) * y).alias("v"))


def _pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    # merge: a row vector may be larger than any broadcast bound
    return a.select("rb", F.col("v").alias("x")).join(b.select("rb", F.col("v").alias("y")).hint("merge"), "rb")


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """a . b of two row vectors of one design: one row (inner_product, n); the tasks' sums
    are all that is exchanged."""
    one = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return _pairs(a, b).agg(F.sum(one).alias("inner_product"), F.sum(F.size("x")).cast("bigint").alias("n"))


def adjoint_product(blocks: DataFrame, r: DataFrame, out: str = "value") -> DataFrame:
    """A' r for a row vector r: (col_id, value)."""
    joined = blocks.select("rb", "rows", "features").join(r.hint("merge"), "rb")

    def task(it):
        passes.single_thread_blas()
        total = None
        for b in it:
            for n, f, v in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                got = _doubles(f).reshape(n, -1).T @ v.values.to_numpy(zero_copy_only=False)
                total = got if total is None else total + got
        if total is not None:
            yield passes.emit_blocks(total)

    def unpack(it):
        import pyarrow as pa
        for b in it:
            for block, v in zip(b.column(0).to_pylist(), b.column(1)):
                at = block * passes.BLOCK
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(v.values), dtype=np.int32)), v.values], names=["col_id", out])

    parts = joined.select("rows", "features", "v").mapInArrow(task, passes.PARTIAL_SCHEMA)
    return passes.sum_table(parts).mapInArrow(unpack, f"col_id int, {out} double")


def rows_of(v: DataFrame, out: str = "value") -> DataFrame:
    """(rb, place, value): a row vector as rows, place being that in its block."""
    return v.select("rb", F.posexplode("v").alias("place", out))
