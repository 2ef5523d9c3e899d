"""Evaluators (O44): how a fit evaluates the smooth part.

Every evaluator answers ``evaluate(V, use_label, grad_for)``: for each
column v_j of V the half squared norm of ``A v_j - flag_j b`` and, for the
requested j, the gradient ``A^T (A v_j - flag_j b)``. Those over blocks of rows also
answer ``scan(V, rows, n_scalars, g)``: products A V, any function of the rows'
products and labels, and the adjoint of what it returns (``passes.row_pass``), which is
what other losses need. ``scans`` counts the Spark scans of the design it has made.

* ``DenseEvaluator``: packed rows, coefficients as one broadcast; takes a user's map;
* ``NarrowEvaluator``: a few scalar columns and SQL aggregates, for squared error;
* ``SparseEvaluator``: packed sparse rows made from cells, the same passes;
* ``ColumnBlockEvaluator``: rows x columns in pieces, coefficients as a table joined by
  column block: for vectors above the broadcast bound;
* ``GramEvaluator``: one scan for A'A, then none; ``CellEvaluator``: SQL only.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penfit.operators import passes
from penfit.operators.maps import MatrixMap
from penfit.operators.passes import (INVALID, MAX_BROADCAST_BYTES, GramResult, PassResult, blockify,
                                     csr_blocks, gram_pass, row_pass, squared_rows)
from penfit.sources.design import NARROW, DesignInfo, known_width, validate_cells, validate_design

# Below this many design bytes per task, a task's fixed cost (scheduling, the
# Python round trip) outweighs its work: small cached designs are coalesced.
MIN_TASK_BYTES = 4 * 1024 * 1024
# Every pass ships one partial vector per task, so tasks per pass are capped
# at this many per core: the partial volume is bounded by cores x p, not by
# the number of input splits (100 TB in 128 MB splits is ~800k tasks).
TASKS_PER_CORE = 3
# A cached partition holding more than this many times the mean rows is a
# straggler in every pass: the cached blocks are then re-spread once.
SKEW_FACTOR = 4.0
# Coefficient vectors that a pass evaluates at once, at most.
PASS_VECTORS = 3


def task_count(spark, parts: int, n: int, p: int) -> int:
    """Tasks for a pass: fewer for tiny designs, at most TASKS_PER_CORE per core."""
    want = max(1, -(-n * (p + 1) * 8 // MIN_TASK_BYTES))
    cap = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return max(1, min(parts, want, cap))


def invalid_input(e: Exception) -> ValueError | None:
    """The ValueError a task raised for bad input, out of Spark's wrapper."""
    msg = str(e)
    i = msg.find(INVALID)
    if i < 0:
        return None
    return ValueError(msg[i + len(INVALID):].strip().splitlines()[0])


class _BlockEvaluator:
    """``evaluate`` by means of ``scan``."""

    loss = None

    def evaluate(self, V, use_label, grad_for=()) -> PassResult:
        V = np.asarray(V, dtype=np.float64).reshape(self.p, -1)
        k, gidx = V.shape[1], [int(j) for j in grad_for]
        if self.loss is not None and k != 1:
            raise ValueError("a loss plug-in is evaluated for one coefficient vector at a time")
        flags = np.asarray(use_label, dtype=np.float64).reshape(k)
        rows, scalars = squared_rows(flags, gidx, self.loss)
        n, C, G = self.scan(V, rows, scalars, len(gidx))
        C = C.reshape(k, k)
        C = 0.5 * (C + C.T)
        return PassResult(n, 0.5 * np.diag(C).copy(), G, C)

    def _checked(self, got):
        if got[0] != self.n:
            raise RuntimeError(f"pass saw {got[0]} rows, expected {self.n}")
        return got


class DenseEvaluator(_BlockEvaluator):
    """Arrow passes over the persisted design.

    The design is cached once in blocks of rows with packed float64 buffers
    (``passes.blockify``); the job that fills the cache also checks every
    value. Later passes read a few large binary values per task instead of
    one array per row.
    """

    def __init__(self, design: DataFrame, persist: bool = True, info: DesignInfo | None = None,
                 checkpoint: bool = False, loss=None, linear_map=None):
        self.loss = loss
        self.map = linear_map if linear_map is not None else MatrixMap()
        rows = design.select(F.col("label").cast("double").alias("label"), "features")
        self._cached = None
        self.blocked = persist
        self.rebalanced = False
        if persist:
            # The input runs once: the job that fills this cache also gives n, p
            # and the rows per partition. Nothing asks the plan for its
            # partitions before (that would run its shuffles).
            blocks = blockify(rows, info.p if info is not None else None)
            try:
                if checkpoint:
                    from penfit.session import ensure_checkpoint_dir
                    ensure_checkpoint_dir(rows.sparkSession)
                    blocks = blocks.checkpoint(eager=True)
                self.df = self._cached = blocks.persist(StorageLevel.MEMORY_AND_DISK)
                s = self._partition_rows()
            except Exception as e:  # bad values found while writing or caching
                self.close()
                err = invalid_input(e)
                if err is not None:
                    raise err from None
                raise
            if not s["n"]:
                self.close()
                raise ValueError("design has no rows")
            if s["pmin"] != s["pmax"]:
                self.close()
                raise ValueError(f"unequal feature lengths: {s['pmin']} to {s['pmax']}")
            n, used = int(s["n"]), int(s["used"])
            skewed = s["largest"] > SKEW_FACTOR * n / used and s["blocks"] >= used
            target = rows.sparkSession.sparkContext.defaultParallelism
            few = used < target and s["blocks"] > used
            if skewed or few:
                # a hot partition (a key or source with a large share of the rows),
                # or fewer splits than cores: spread the blocks (<= MAX_BLOCK_BYTES
                # each), not the rows; designs read from many files are not shuffled
                balanced = self._cached.repartition(max(used, target)).persist(StorageLevel.MEMORY_AND_DISK)
                balanced.agg(F.sum("rows")).collect()
                self._cached.unpersist()
                self.df = self._cached = balanced
                self.rebalanced = skewed
            self.info = DesignInfo(n, int(s["pmin"]))
        else:
            self.df = rows
            self.info = info if info is not None else validate_design(rows)
        self.n, self.p = self.info.n, self.map.coefficients(self.info.p)
        self.tasks = self.df.rdd.getNumPartitions()
        if self._cached is not None:
            # several cached partitions per task (coalesce: no shuffle, local
            # blocks preferred) when they are tiny or when there are more
            # than TASKS_PER_CORE per core
            want = task_count(self.df.sparkSession, self.tasks, self.n, self.p)
            if want < self.tasks:
                self.df = self._cached.coalesce(want)
                self.tasks = want
        self.scans = 1

    def _partition_rows(self):
        """Rows, columns and the largest cached partition in one row: sums per
        partition are reduced again, so the driver gets one row however many
        partitions there are. This is the job that fills the cache."""
        width = (F.length("features") / F.length("labels")).cast("bigint")
        per = self.df.groupBy(F.spark_partition_id().alias("pid")).agg(
            F.sum("rows").alias("n"), F.count(F.lit(1)).alias("b"),
            F.min(width).alias("lo"), F.max(width).alias("hi"))
        return per.agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.sum("b").alias("blocks"),
                       F.count(F.lit(1)).alias("used"), F.min("lo").alias("pmin"),
                       F.max("hi").alias("pmax")).first()

    def scan(self, V, rows, n_scalars: int, g: int):
        self.scans += 1
        return self._checked(row_pass(self.df, self.p, V, rows, n_scalars, g, "blocks" if self.blocked else "rows",
                                      self.map, self.tasks))

    def gram(self) -> GramResult:
        """A^T A, A^T b, b^T b from the cached blocks; the values were checked
        when the cache was filled."""
        if type(self.map) is not MatrixMap:
            raise ValueError("the Gram strategy takes the design's own matrix")
        return gram_pass(self.df, self.p, tasks=self.tasks, blocked=self.blocked, validate=not self.blocked)

    def close(self):
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None


class NarrowEvaluator:
    """Squared error of a design of ``p`` columns, few and known before it runs: rows are
    cached as scalar columns, and a pass is one aggregate whose sums run in the scan's
    stage. No row goes to Python. The job that fills the cache checks every value, and
    the input runs once."""

    def __init__(self, design: DataFrame, p: int, checkpoint: bool = False):
        self.p, self.scans = p, 1
        self._x = [f"x{i}" for i in range(p)]
        self._cached = None
        try:
            rows = design.select(*_checked_columns(p))
            if checkpoint:
                from penfit.session import ensure_checkpoint_dir
                ensure_checkpoint_dir(rows.sparkSession)
                rows = rows.checkpoint(eager=True)
            self.df = self._cached = rows.persist(StorageLevel.MEMORY_AND_DISK)
            per = self.df.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))
            s = per.agg(F.sum("n").alias("n"), F.max("n").alias("largest"), F.count(F.lit(1)).alias("used")).first()
        except Exception as e:  # bad values found while writing or caching
            self.close()
            err = invalid_input(e)
            if err is not None:
                raise err from None
            raise
        if not s["n"]:
            self.close()
            raise ValueError("design has no rows")
        self.n, used = int(s["n"]), int(s["used"])
        target = rows.sparkSession.sparkContext.defaultParallelism
        small = self.n * (p + 1) * 8 <= MIN_TASK_BYTES
        self.rebalanced = s["largest"] > SKEW_FACTOR * self.n / used and not small
        if self.rebalanced or (used < target and not small):
            # a hot partition or fewer splits than cores: the rows are spread once
            spread = self._cached.repartition(max(used, target)).persist(StorageLevel.MEMORY_AND_DISK)
            spread.count()
            self._cached.unpersist()
            self.df = self._cached = spread
        self.info = DesignInfo(self.n, p)
        parts = self.df.rdd.getNumPartitions()
        self.tasks = task_count(self.df.sparkSession, parts, self.n, p)
        if self.tasks < parts:
            self.df = self._cached.coalesce(self.tasks)

    def _sums(self, src: DataFrame, terms: list) -> list[float]:
        """Sums of the terms over all rows, one scan."""
        self.scans += 1
        r = src.agg(F.count(F.lit(1)), *[F.sum(t) for t in terms]).first()
        if r[0] != self.n:
            raise RuntimeError(f"pass saw {r[0]} rows, expected {self.n}")
        return [float(v) for v in r[1:]]

    def evaluate(self, V, use_label, grad_for=()) -> PassResult:
        V = np.asarray(V, dtype=np.float64).reshape(self.p, -1)
        k, gidx = V.shape[1], [int(j) for j in grad_for]
        flags = np.asarray(use_label, dtype=np.float64).reshape(k)
        made = []
        for j in range(k):
            product = F.col("x0") * F.lit(float(V[0, j]))
            for i in range(1, self.p):
                product = product + F.col(f"x{i}") * F.lit(float(V[i, j]))
            made.append((product - F.col("label") * F.lit(float(flags[j]))).alias(f"r{j}"))
        pairs = [(j, l) for j in range(k) for l in range(j, k)]
        got = self._sums(self.df.select(*self._x, *made),
                         [F.col(f"r{j}") * F.col(f"r{l}") for j, l in pairs]
                         + [F.col(x) * F.col(f"r{j}") for j in gidx for x in self._x])
        C = np.zeros((k, k))
        for (j, l), v in zip(pairs, got):
            C[j, l] = C[l, j] = v
        G = np.array(got[len(pairs):]).reshape(len(gidx), self.p).T
        return PassResult(self.n, 0.5 * np.diag(C).copy(), G, C)

    def gram(self) -> GramResult:
        """A^T A, A^T b, b^T b from the cached columns."""
        cols = [*self._x, "label"]
        pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
        G = np.zeros((len(cols), len(cols)))
        for (i, j), v in zip(pairs, self._sums(self.df, [F.col(cols[i]) * F.col(cols[j]) for i, j in pairs])):
            G[i, j] = G[j, i] = v
        return GramResult(self.n, float(G[-1, -1]), G[:-1, -1].copy(), G[:-1, :-1].copy())

    def close(self):
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None


def _checked_columns(p: int) -> list:
    """label, x0, x1, ...: never null; a row with another number of features, or a null,
    NaN or infinite value is an error of the job that reads it."""
    def stop(why):
        return F.raise_error(F.lit(f"{INVALID} {why}")).cast("double")

    def finite(v):
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))),
                      stop("null, NaN or infinite label or feature")).otherwise(v)

    width = F.coalesce(F.size("features"), F.lit(-1))
    label = F.when(width != p, stop(f"feature arrays must all have length {p}")).otherwise(
        finite(F.col("label").cast("double")))
    cells = [finite(F.get("features", F.lit(i)).cast("double")) for i in range(p)]
    return [F.coalesce(v, F.lit(0.0)).alias(name)
            for v, name in zip([label, *cells], ["label", *[f"x{i}" for i in range(p)]])]


class SparseEvaluator(_BlockEvaluator):
    """Arrow passes over packed sparse rows: a block holds its rows' entries as three
    buffers, work and memory follow the entries, and a task's partial gradient has the
    column blocks that its entries touch."""

    def __init__(self, cells: DataFrame, labels: DataFrame, p: int, loss=None, persist: bool = True):
        self.loss, self.p, self.scans = loss, int(p), 1
        blocks = csr_blocks(cells, labels, self.p)
        self._cached = self.df = blocks.persist(StorageLevel.MEMORY_AND_DISK) if persist else blocks
        try:
            self.n = int(self.df.agg(F.sum("rows")).first()[0] or 0)
        except Exception as e:
            self.close()
            raise invalid_input(e) or e from None
        if not self.n:
            self.close()
            raise ValueError("design has no rows")
        self.tasks = self.df.rdd.getNumPartitions()

    def scan(self, V, rows, n_scalars: int, g: int):
        self.scans += 1
        return self._checked(row_pass(self.df, self.p, V, rows, n_scalars, g, "csr", None, self.tasks))

    def close(self):
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None


#: Columns of a piece of the column-blocked layout, and the most bytes of the pieces that
#: one group (a column block of a slice of the rows) holds.
COLUMN_BLOCK = 8192
SLICE_BYTES = 64 * 1024 * 1024


class ColumnBlockEvaluator(_BlockEvaluator):
    """No vector of length p in any task: the design is cut into pieces (row block x
    column block), kept partitioned by (column block, slice of row blocks) and
    sorted, written to the checkpoint folder first. A pass joins the coefficients,
    a table of column blocks, to the pieces; the partial products (one number per row and
    column block) are summed per row block, the row function is applied there, and what it
    returns goes back to the pieces for the partial gradients. Only coefficients
    and row vectors are shuffled, never the matrix."""

    def __init__(self, blocks: DataFrame, n: int, p: int, loss=None, column_block: int | None = None):
        from penfit.session import ensure_checkpoint_dir
        self.spark, self.loss, self.n, self.p, self.scans = blocks.sparkSession, loss, n, p, 1
        self.width = column_block or COLUMN_BLOCK
        self.columns = -(-p // self.width)
        self.slices = max(1, -(-n * self.width * 8 // SLICE_BYTES))
        ensure_checkpoint_dir(self.spark)
        # written once: the pieces of a row block must come from one evaluation of the input
        pieces = blocks.mapInArrow(_cut(p, self.width, self.slices), _PIECES).checkpoint(eager=True)
        target = max(self.columns * self.slices, self.spark.sparkContext.defaultParallelism)
        self.labels = pieces.where("cb < 0").select("rb", "rs", "rows", "payload")
        self.pieces = (pieces.where("cb >= 0").repartition(target, "cb", "rs").sortWithinPartitions("cb", "rs")
                       .persist(StorageLevel.MEMORY_AND_DISK))

    def _coefficients(self, V):
        import pandas as pd
        held = [np.ascontiguousarray(V[a:a + self.width]).tobytes() for a in range(0, self.p, self.width)]
        table = self.spark.createDataFrame(pd.DataFrame({"cb": np.arange(len(held), dtype=np.int32), "v": held}),
                                           "cb int, v binary")
        return table.select("cb", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("rs"), "v")

    def products(self, V) -> DataFrame:
        """(rb, rs, rows, payload): partial products of every piece, rows x k doubles."""
        V = np.asarray(V, dtype=np.float64).reshape(self.p, -1)
        return self.pieces.groupBy("cb", "rs").cogroup(self._coefficients(V).groupBy("cb", "rs")).applyInArrow(
            _multiply(V.shape[1]), "rb bigint, rs int, rows int, payload binary")

    def scan(self, V, rows, n_scalars: int, g: int):
        self.scans += 1
        V = np.asarray(V, dtype=np.float64).reshape(self.p, -1)
        both = self.products(V).withColumn("label", F.lit(False)).unionByName(
            self.labels.withColumn("label", F.lit(True)))
        summed = both.groupBy("rs").applyInArrow(
            _sum_rows(rows, V.shape[1], n_scalars), "rs int, scalars array<double>, rbs binary, sizes binary, payload binary")
        summed = summed.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            s = summed.agg(*[F.sum(F.col("scalars")[i]).alias(f"s{i}") for i in range(n_scalars + 1)]).first()
            grads = np.zeros((self.p, g))
            if g:
                back = summed.select(F.explode(F.sequence(F.lit(0), F.lit(self.columns - 1))).alias("cb"), "rs", "rbs",
                                     "sizes", "payload")
                parts = self.pieces.groupBy("cb", "rs").cogroup(back.groupBy("cb", "rs")).applyInArrow(
                    _adjoint(g), "block int, v array<double>")
                for r in passes.sum_table(parts, self.slices).toLocalIterator():
                    v = np.array(r["v"]).reshape(-1, g)
                    grads[r["block"] * self.width:r["block"] * self.width + len(v)] = v
        finally:
            summed.unpersist()
        return self._checked((int(round(s[0])), np.array([s[i + 1] for i in range(n_scalars)]), grads))

    def close(self):
        self.pieces.unpersist()


_PIECES = "rb bigint, rs int, cb int, rows int, payload binary"


def _cut(p: int, width: int, slices: int):
    def run(it):
        import pyarrow as pa
        from pyspark import TaskContext
        at = TaskContext.get().partitionId() << 32
        for b in it:
            for y, M in passes.iter_xy(b, p, True):
                rows, payload = [-1], [y.tobytes()]
                for c in range(0, p, width):
                    rows.append(c // width)
                    payload.append(np.ascontiguousarray(M[:, c:c + width]).tobytes())
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at] * n, pa.int64()), pa.array([(at ^ (at >> 32)) % slices] * n, pa.int32()),
                     pa.array(rows, pa.int32()), pa.array([len(y)] * n, pa.int32()), pa.array(payload, pa.binary())],
                    names=["rb", "rs", "cb", "rows", "payload"])
                at += 1
    return run


def _multiply(k: int):
    def run(key, pieces, coefficients):
        import pyarrow as pa
        v = np.frombuffer(coefficients.column("v")[0].as_buffer(), "<f8").reshape(-1, k)
        out = []
        for payload, rows in zip(pieces.column("payload"), pieces.column("rows").to_pylist()):
            out.append((np.frombuffer(payload.as_buffer(), "<f8").reshape(rows, -1) @ v).tobytes())
        return pa.table([pieces.column("rb"), pieces.column("rs"), pieces.column("rows"), pa.array(out, pa.binary())],
                        names=["rb", "rs", "rows", "payload"])
    return run


def _sum_rows(rows, k: int, n_scalars: int):
    def run(key, table):
        import pyarrow as pa
        labels, held = {}, {}
        for rb, n, payload, is_label in zip(*[table.column(c).to_pylist() for c in ("rb", "rows", "payload", "label")]):
            v = np.frombuffer(payload, "<f8")
            if is_label:
                labels[rb] = v
            else:
                held[rb] = held[rb] + v if rb in held else v
        total, sizes, parts = np.zeros(1 + n_scalars), [], []
        for rb, y in labels.items():
            scalars, S = rows(y, held[rb].reshape(len(y), k))
            total += np.concatenate([[float(len(y))], scalars])
            sizes.append(len(y))
            parts.append(b"" if S is None else np.ascontiguousarray(S).tobytes())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64())),
                         pa.array([np.array(list(labels), np.int64).tobytes()], pa.binary()),
                         pa.array([np.array(sizes, np.int32).tobytes()], pa.binary()), pa.array([b"".join(parts)], pa.binary())],
                        names=["rs", "scalars", "rbs", "sizes", "payload"])
    return run


def _adjoint(g: int):
    def run(key, pieces, back):
        import pyarrow as pa
        sizes = np.frombuffer(back.column("sizes")[0].as_buffer(), np.int32)
        S = np.frombuffer(back.column("payload")[0].as_buffer(), "<f8").reshape(-1, g)
        ends = np.cumsum(sizes)
        of = {int(rb): S[e - n:e] for rb, n, e in
              zip(np.frombuffer(back.column("rbs")[0].as_buffer(), np.int64), sizes, ends)}
        total = 0.0
        for rb, rows, payload in zip(pieces.column("rb").to_pylist(), pieces.column("rows").to_pylist(), pieces.column("payload")):
            total = total + np.frombuffer(payload.as_buffer(), "<f8").reshape(rows, -1).T @ of[rb]
        return pa.table([pa.array([key[0].as_py()], pa.int32()),
                         pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["block", "v"])
    return run


class GramEvaluator:
    """One scan for A^T A, A^T b, b^T b; every evaluation after it is local
    (P14). Losses come from 1/2 v^T G v - c^T v + 1/2 b^T b, which cancels
    when the optimum loss is far below b^T b: re-check a final objective with
    a dense pass when that matters."""

    def __init__(self, design: DataFrame | None = None, gram: GramResult | None = None,
                 info: DesignInfo | None = None, scans: int = 0):
        if gram is None:
            dense = DenseEvaluator(design, info=info)
            try:
                gram = dense.gram()
            finally:
                dense.close()
            self.scans = 1
        else:
            self.scans = scans
        self.g = gram
        self.n, self.p = gram.n, gram.c.shape[0]

    def evaluate(self, V, use_label, grad_for=()) -> PassResult:
        V = np.asarray(V, dtype=np.float64).reshape(self.p, -1)
        flags = np.asarray(use_label, dtype=np.float64).reshape(V.shape[1])
        GV = self.g.G @ V
        cv = self.g.c @ V
        C = V.T @ GV - np.outer(cv, flags) - np.outer(flags, cv) + np.outer(flags, flags) * self.g.bb
        losses = 0.5 * np.einsum("ij,ij->j", V, GV) - flags * cv + 0.5 * flags * self.g.bb
        grads = GV[:, list(grad_for)] - np.outer(self.g.c, flags[list(grad_for)])
        return PassResult(self.n, losses, grads, C)

    def close(self):
        pass


class CellEvaluator:
    """Cell layout (row_id, col_id, value) + labels (row_id, label), all in
    SQL: predictions by a join with the weights table and a group by row,
    gradients by a join with the residuals and a group by column. The weights
    table is broadcast only while it is under the broadcast bound."""

    def __init__(self, cells: DataFrame, labels: DataFrame, p: int | None = None,
                 persist: bool = True):
        self.cells = cells.select(F.col("row_id").cast("bigint"), F.col("col_id").cast("int"),
                                  F.col("value").cast("double"))
        self.labels = labels.select(F.col("row_id").cast("bigint"),
                                    F.col("label").cast("double"))
        self._persist = persist
        if persist:
            # both by row_id: sums by row and joins by row need no exchange later
            self.cells = self.cells.repartition("row_id").persist(StorageLevel.MEMORY_AND_DISK)
            self.labels = self.labels.repartition("row_id").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.info = validate_cells(self.cells, self.labels, p)
        except Exception:
            self.close()
            raise
        self.n, self.p = self.info.n, self.info.p
        self.scans = 3
        self.spark = self.cells.sparkSession

    def _weights(self, V):
        import pandas as pd
        k = V.shape[1]
        pdf = pd.DataFrame({"col_id": np.arange(self.p, dtype=np.int32)})
        for j in range(k):
            pdf[f"w{j}"] = V[:, j]
        w = self.spark.createDataFrame(pdf)
        return F.broadcast(w) if V.nbytes + 4 * self.p <= MAX_BROADCAST_BYTES else w

    def evaluate(self, V, use_label, grad_for=()) -> PassResult:
        V = np.asarray(V, dtype=np.float64).reshape(self.p, -1)
        k = V.shape[1]
        flags = list(np.asarray(use_label, dtype=np.float64).reshape(k))
        w = self._weights(V)
        pred = (self.cells.join(w, "col_id")
                .groupBy("row_id")
                .agg(*[F.sum(F.col("value") * F.col(f"w{j}")).alias(f"a{j}") for j in range(k)]))
        res = (self.labels.join(pred, "row_id", "left")
               .select("row_id", *[(F.coalesce(F.col(f"a{j}"), F.lit(0.0))
                                    - F.lit(flags[j]) * F.col("label")).alias(f"r{j}")
                                   for j in range(k)]))
        self.scans += 1
        gidx = list(grad_for)
        if gidx:
            res = res.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            lr = res.agg(*[F.sum(F.col(f"r{j}") * F.col(f"r{l}")).alias(f"c{j}_{l}")
                           for j in range(k) for l in range(j, k)]).first()
            C = np.zeros((k, k))
            for j in range(k):
                for l in range(j, k):
                    C[j, l] = C[l, j] = lr[f"c{j}_{l}"]
            losses = 0.5 * np.diag(C).copy()
            grads = np.zeros((self.p, len(gidx)))
            if gidx:
                self.scans += 1
                g = (self.cells.join(res, "row_id")
                     .groupBy("col_id")
                     .agg(*[F.sum(F.col("value") * F.col(f"r{j}")).alias(f"g{i}")
                            for i, j in enumerate(gidx)])).toPandas()
                cols = g["col_id"].to_numpy()
                for i in range(len(gidx)):
                    grads[cols, i] = g[f"g{i}"].to_numpy()
        finally:
            if gidx:
                res.unpersist()
        return PassResult(self.n, losses, grads, C)

    def close(self):
        if self._persist:
            self.cells.unpersist()
            self.labels.unpersist()
            self._persist = False


def make_evaluator(design=None, cfg=None, cells=None, labels=None, method: str = "accelerated"):
    """Pick the evaluator for a config: SQL or packed sparse rows when the layout says so
    (or only cells are given), Gram when asked for, SQL aggregates for squared error of a
    few known columns, column blocks when the coefficients of a pass are above the
    broadcast bound, Arrow passes otherwise."""
    if cfg.layout in ("cells", "sparse") or design is None:
        if cells is None:
            from penfit.sources.design import to_cells
            cells, labels = to_cells(design)
        if cfg.layout != "sparse":
            return CellEvaluator(cells, labels, persist=cfg.persist)
        info = validate_cells(cells, labels, cfg.columns)
        return SparseEvaluator(cells, labels, info.p, loss=cfg.loss, persist=cfg.persist)
    width = known_width(design)
    if width is not None and 1 <= width <= NARROW and cfg.persist and cfg.loss is None and cfg.linear_map is None:
        dense = NarrowEvaluator(design, width, checkpoint=cfg.checkpoint)
    else:
        dense = DenseEvaluator(design, persist=cfg.persist, checkpoint=cfg.checkpoint, loss=cfg.loss,
                               linear_map=cfg.linear_map)
    if cfg.strategy == "gram" or (cfg.strategy == "auto" and dense.p <= cfg.gram_max_p
                                  and cfg.loss is None and cfg.linear_map is None):
        try:
            return GramEvaluator(gram=dense.gram(), scans=1)
        finally:
            dense.close()
    if PASS_VECTORS * dense.p * 8 > passes.MAX_BROADCAST_BYTES and cfg.persist and cfg.linear_map is None:
        try:
            return ColumnBlockEvaluator(dense.df, dense.n, dense.p, loss=cfg.loss)
        finally:
            dense.close()
    return dense
