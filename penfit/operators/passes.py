"""Arrow passes over a dense design: the large-vector aggregates (O16, O26-O28,
P1, P3, P6, P14).

One scan evaluates k coefficient vectors at once. Each task turns its Arrow
batches into a NumPy matrix M (rows x p), accumulates products in place and
emits ONE partial vector ``[n, losses(k), gradients(g*p)]`` (or the Gram
partial), cut into blocks of ``BLOCK`` doubles. The blocks are summed by a
JVM-side ``groupBy(block)`` + ``Summarizer.sum``: partial and final
aggregation are Spark's, the final merge is spread over p/BLOCK groups, and
a reducer holds one block, never a whole group of task partials.

Shuffle volume per pass is tasks x (1 + k + g*p) doubles, against a scan of
n x p doubles: for tasks of >= 1,000 rows it is under 0.1 % of the scan.
Only p-length results reach the driver.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penfit.session import ship_package

BLOCK = 8192
# Coefficient matrices larger than this are not broadcast: the cell layout
# (a weights table joined on col_id) takes over.
MAX_BROADCAST_BYTES = 512 * 1024 * 1024
# Task partials whose total size (tasks x length x 8 bytes) is under this are
# added on the driver, the last level of a tree aggregate; anything larger is
# summed block-wise by Spark. The bound is checked before the job runs.
DRIVER_MERGE_BYTES = 16 * 1024 * 1024
# Coefficient blocks up to this size are shipped in the task closure.
CLOSURE_BYTES = 256 * 1024
PARTIAL_SCHEMA = "block int, v array<double>"


_BLAS_PINNED = False


def single_thread_blas() -> None:
    """Once per Python worker: one BLAS thread, since every core already runs
    a worker. Sessions of this package set OPENBLAS_NUM_THREADS=1 for
    executors; this covers sessions that do not (an explicit setting wins)."""
    global _BLAS_PINNED
    if _BLAS_PINNED:
        return
    _BLAS_PINNED = True
    if os.environ.get("OPENBLAS_NUM_THREADS"):
        return
    try:
        import ctypes
        import glob
        libdir = os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs")
        for path in glob.glob(os.path.join(libdir, "*openblas*")):
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_",
                         "openblas_set_num_threads"):
                fn = getattr(lib, name, None)
                if fn is not None:
                    fn(1)
                    return
    except Exception:  # a BLAS we do not know: leave it as it is
        pass


def features_matrix(col: pa.Array, p: int) -> np.ndarray:
    """Arrow list<double> column -> (rows, p) float64 matrix without a copy
    when the buffer allows it. Raises on unequal lengths or nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    rows = len(col)
    offs = col.offsets.to_numpy()
    if rows and (offs[-1] - offs[0] != rows * p or np.any(np.diff(offs) != p)):
        raise ValueError(f"feature arrays must all have length {p}")
    vals = col.flatten()
    if vals.null_count or col.null_count:
        raise ValueError("null in features")
    vals = vals.to_numpy(zero_copy_only=False)
    if vals.dtype != np.float64:
        vals = vals.astype(np.float64)
    return vals.reshape(rows, p)


INVALID = "penfit-invalid:"
BLOCK_SCHEMA = "rows int, labels binary, features binary"
MAX_BLOCK_BYTES = 4 * 1024 * 1024


def check_finite(y: np.ndarray, M: np.ndarray) -> None:
    if not (np.isfinite(y).all() and np.isfinite(M).all()):
        raise ValueError(f"{INVALID} NaN or infinite label or feature")


def _binary_slices(col: pa.Array):
    """(data buffer, start offsets, end offsets) of a binary column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        raise ValueError(f"{INVALID} null block")
    _, obuf, dbuf = col.buffers()
    wide = pa.types.is_large_binary(col.type)
    offs = np.frombuffer(obuf, dtype=np.int64 if wide else np.int32, count=len(col) + 1,
                         offset=col.offset * (8 if wide else 4))
    return dbuf, offs


def iter_xy(batch: pa.RecordBatch, p: int, blocked: bool, validate: bool = False):
    """(labels, feature matrix) pieces of one Arrow batch in either layout:
    rows (label double, features array<double>) or blocks (rows, labels
    binary, features binary) with row-major float64 buffers."""
    if not blocked:
        y = label_vector(batch.column(0))
        M = features_matrix(batch.column(1), p)
        if validate:
            check_finite(y, M)
        yield y, M
        return
    rows = batch.column(0).to_numpy()
    lbuf, loff = _binary_slices(batch.column(1))
    fbuf, foff = _binary_slices(batch.column(2))
    for i, r in enumerate(rows):
        r = int(r)
        y = np.frombuffer(lbuf, dtype="<f8", count=r, offset=int(loff[i]))
        M = np.frombuffer(fbuf, dtype="<f8", count=r * p, offset=int(foff[i])).reshape(r, p)
        yield y, M


class CsrBlock:
    """Rows of a sparse matrix: row of every entry, columns, values."""

    __slots__ = ("rows", "row", "columns", "values")

    def __init__(self, rows: int, counts: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.rows, self.columns, self.values = rows, columns, values
        self.row = np.repeat(np.arange(rows), counts)


def iter_blocks(batch: pa.RecordBatch, p: int, layout: str, amap):
    """(labels, block) of one Arrow batch; ``csr`` blocks are ``CsrBlock``."""
    if layout != "csr":
        yield from iter_xy(batch, amap.raw_width(p), layout == "blocks")
        return
    held = batch.column(0).to_numpy()
    cols = [_binary_slices(batch.column(i)) for i in range(1, 5)]

    def part(j, i, dtype):
        data, offs = cols[j]
        size = int(offs[i + 1] - offs[i]) // np.dtype(dtype).itemsize
        return np.frombuffer(data, dtype, count=size, offset=int(offs[i])) if size else np.empty(0, dtype)

    for i, r in enumerate(held):
        yield part(0, i, "<f8"), CsrBlock(int(r), part(1, i, "<i4"), part(2, i, "<i4"), part(3, i, "<f8"))


CSR_SCHEMA = "rows int, labels binary, counts binary, columns binary, entries binary"


def csr_blocks(cells: DataFrame, labels: DataFrame, p: int) -> DataFrame:
    """Cells (row_id, col_id, value) and labels (row_id, label) -> packed blocks of
    sparse rows. One shuffle by row_id gathers each row's cells; rows without cells
    stay. Raises on a cell without a label's row, a column outside [0, p), and a null,
    NaN or infinite value."""
    ship_package(cells.sparkSession)
    held = cells.select("row_id", F.struct("col_id", "value").alias("cell")).groupBy("row_id").agg(
        F.collect_list("cell").alias("cells"))
    joined = labels.select("row_id", F.col("label").cast("double").alias("label")).join(held, "row_id", "full_outer")
    rows = joined.select("label", F.transform("cells", lambda c: c["col_id"].cast("int")).alias("columns"),
                         F.transform("cells", lambda c: c["value"].cast("double")).alias("entries"))
    most = MAX_BLOCK_BYTES // 12

    def packed(y, counts, columns, entries):
        return pa.RecordBatch.from_arrays(
            [pa.array([len(y)], pa.int32()),
             *[pa.array([np.ascontiguousarray(v, t).tobytes()], pa.binary())
               for v, t in ((y, "<f8"), (counts, "<i4"), (columns, "<i4"), (entries, "<f8"))]],
            names=["rows", "labels", "counts", "columns", "entries"])

    def task(it):
        for b in it:
            if b.num_rows == 0:
                continue
            y = b.column(0)
            if y.null_count:
                raise ValueError(f"{INVALID} null label, or cells of a row without a label")
            y = y.to_numpy(zero_copy_only=False)
            counts = np.nan_to_num(pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)).astype(np.int32)
            columns, entries = b.column(1).flatten(), b.column(2).flatten()
            if columns.null_count or entries.null_count:
                raise ValueError(f"{INVALID} null cell")
            columns, entries = columns.to_numpy(), entries.to_numpy()
            if columns.size and (columns.min() < 0 or columns.max() >= p):
                raise ValueError(f"{INVALID} col_id outside [0, {p})")
            check_finite(y, entries)
            ends = np.concatenate([[0], np.cumsum(counts)])
            lo = 0
            while lo < len(y):  # blocks of at most ``most`` entries, one row at least
                hi = int(np.searchsorted(ends, ends[lo] + most, "right")) - 1
                hi = min(max(hi, lo + 1), len(y), lo + 65536)
                yield packed(y[lo:hi], counts[lo:hi], columns[ends[lo]:ends[hi]], entries[ends[lo]:ends[hi]])
                lo = hi

    return rows.mapInArrow(task, CSR_SCHEMA)


def first_width(col: pa.Array) -> int:
    """Length of the first feature array of a batch."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    width = len(col[0].as_py() or ()) if col[0].is_valid else 0
    if width < 1:
        raise ValueError("no features (null or empty feature array)")
    return width


def blockify(design: DataFrame, p: int | None = None, label: str = "label",
             features: str = "features") -> DataFrame:
    """Rows -> blocks of rows with packed little-endian float64 buffers (the
    layout MLlib stacks instances into). Each block holds at most
    MAX_BLOCK_BYTES of features, so Arrow batches stay small; checks every
    value once (lengths, nulls, NaN, infinity). Later passes move a few large
    binary values per task instead of one array per row. Without ``p`` a task
    takes the length of its first row; who reads the blocks compares the tasks'
    (length of features / length of labels of any block)."""
    ship_package(design.sparkSession)
    known, most = p, MAX_BLOCK_BYTES

    def task(it):
        single_thread_blas()
        p = known
        for b in it:
            if b.num_rows == 0:
                continue
            try:
                p = first_width(b.column(1)) if p is None else p
                y = label_vector(b.column(0))
                M = features_matrix(b.column(1), p)
            except ValueError as e:
                raise ValueError(f"{INVALID} {e}") from None
            check_finite(y, M)
            rows_per_block = max(1, min(65536, most // (8 * p)))
            starts = np.arange(0, len(y), rows_per_block)
            counts = np.minimum(rows_per_block, len(y) - starts).astype(np.int32)
            # int32 offsets: an input batch is at most 64 MB (Spark's Arrow bound)
            loffs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts),
                 pa.Array.from_buffers(pa.binary(), len(counts),
                                       [None, pa.py_buffer(loffs.astype(np.int32)),
                                        pa.py_buffer(y.tobytes())]),
                 pa.Array.from_buffers(pa.binary(), len(counts),
                                       [None, pa.py_buffer((loffs * p).astype(np.int32)),
                                        pa.py_buffer(np.ascontiguousarray(M).tobytes())])],
                names=["rows", "labels", "features"])

    return design.select(F.col(label).cast("double"), F.col(features)) \
        .mapInArrow(task, BLOCK_SCHEMA)


def label_vector(col: pa.Array) -> np.ndarray:
    if col.null_count:
        raise ValueError("null label")
    return col.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def emit_blocks(flat: np.ndarray):
    """One partial vector -> record batch of (block, values) rows."""
    nb = max(1, -(-len(flat) // BLOCK))
    offsets = np.minimum(np.arange(nb + 1, dtype=np.int64) * BLOCK, len(flat)).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(nb, dtype=np.int32)), values],
                                      names=["block", "v"])


def sum_blocks(parts: DataFrame, length: int, tasks: int | None = None) -> np.ndarray:
    """Sum task partials; return the length-`length` total on the driver
    (missing blocks: no task had rows). With ``tasks`` known and the partial
    volume under DRIVER_MERGE_BYTES the partials are fetched and added in
    NumPy (one stage less); otherwise Spark sums them per block."""
    out = np.zeros(length)
    if tasks is not None and tasks * length * 8 <= DRIVER_MERGE_BYTES:
        tbl = parts.toArrow()
        blocks = tbl.column("block").to_numpy()
        col = tbl.column("v").combine_chunks()
        offs = col.offsets.to_numpy()
        vals = col.flatten().to_numpy()
        for i, b in enumerate(blocks):
            start = int(b) * BLOCK
            out[start:start + offs[i + 1] - offs[i]] += vals[offs[i]:offs[i + 1]]
        return out
    agg = (parts.groupBy("block")
           .agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")))
    tbl = agg.toArrow()
    blocks = tbl.column("block").to_numpy()
    vals = tbl.column("v").to_pylist()
    for b, v in zip(blocks, vals):
        start = int(b) * BLOCK
        out[start:start + len(v)] = v
    return out


#: Partials of at most this many tasks are added in one step; more in two.
FAN_IN = 64


def sum_table(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Task partials (block, v) summed to one row per block, as a table. Above
    ``FAN_IN`` tasks (or an unknown number) a block's partials are first added in
    about sqrt(tasks) groups, so no reducer reads all of a block's partials."""
    add = vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")
    if tasks is None or tasks > FAN_IN:
        width = FAN_IN if tasks is None else max(2, int(tasks ** 0.5))
        group = F.pmod(F.spark_partition_id(), F.lit(width))
        parts = parts.groupBy("block", group.alias("level")).agg(add)
    return parts.groupBy("block").agg(add)


def column_table(design: DataFrame, per_block, schema: str, finish, scalars: int = 0,
                 columns=("features",)) -> DataFrame:
    """One scan -> one row per feature column, without a row per cell.
    ``per_block(M, *others)`` gives the columns' partial sums (a p-vector) and an array
    of ``scalars`` numbers; every task sends blocks of [scalars, sums of some columns],
    which are added in levels and unpacked to ``col_id`` and the columns of ``schema``.
    ``finish(scalars, sums)`` makes these of a block's totals."""
    ship_package(design.sparkSession)
    names = ["col_id", *[c.split()[0] for c in schema.split(", ")]]
    width, head = BLOCK, scalars

    def task(it):
        single_thread_blas()
        total, numbers, p = None, np.zeros(head), None
        for b in it:
            if b.num_rows == 0:
                continue
            p = first_width(b.column(0)) if p is None else p
            M = features_matrix(b.column(0), p)
            got, extra = per_block(M, *[label_vector(b.column(i)) for i in range(1, len(columns))])
            total = got if total is None else total + got
            numbers = numbers + extra
        if total is None:
            return
        rows = [np.concatenate([numbers, total[at:at + width]]) for at in range(0, p, width)]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(rows), dtype=np.int32)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))], names=["block", "v"])

    def unpack(it):
        for b in it:
            for at, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = v.values.to_numpy(zero_copy_only=False)
                made = finish(v[:head], v[head:])
                ids = np.arange(at * width, at * width + len(v) - head, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(c) for c in made]], names=names)

    parts = design.select(*columns).mapInArrow(task, PARTIAL_SCHEMA)
    return sum_table(parts).mapInArrow(unpack, "col_id int, " + schema)


@dataclass
class PassResult:
    n: int
    losses: np.ndarray      # (k,) half sums of squares of r_j = A v_j - flag_j b
    grads: np.ndarray       # (p, g) A^T r_j for the requested j
    cross: np.ndarray | None = None   # (k, k) r_j . r_l


def _check_broadcast(nbytes: int) -> None:
    if nbytes > MAX_BROADCAST_BYTES:
        raise ValueError(f"coefficient block of {nbytes} bytes exceeds the broadcast bound "
                         f"{MAX_BROADCAST_BYTES}; use the cell layout")


def row_pass(blocks: DataFrame, p: int, V: np.ndarray, rows, n_scalars: int, g: int, layout: str = "blocks",
             linear_map=None, tasks: int | None = None):
    """One scan of a design for any smooth function of A V: per block of rows,
    ``rows(b, P)`` gets the labels and the products P = A V (rows x k) and returns
    ``n_scalars`` numbers to be added up and S (rows x g), whose A^T S is added up.
    Returns (n, scalars, A^T S as p x g).

    ``layout``: "rows" (label, features), "blocks" (packed rows, ``blockify``) or "csr"
    (packed sparse rows, ``csr_blocks``). ``linear_map`` replaces A by a user's map of
    the blocks (see ``maps``); p is its number of coefficients."""
    from penfit.operators.maps import MatrixMap
    ship_package(blocks.sparkSession)
    V = np.ascontiguousarray(np.asarray(V, dtype=np.float64).reshape(p, -1))
    _check_broadcast(V.nbytes)
    sc = blocks.sparkSession.sparkContext
    # small blocks travel inside the task closure (no broadcast round trip);
    # larger ones as a broadcast, released after the pass
    bc = sc.broadcast(V) if V.nbytes > CLOSURE_BYTES else None
    held = V if bc is None else None
    amap = linear_map if linear_map is not None else MatrixMap()
    head = 1 + n_scalars

    def task(it):
        single_thread_blas()
        Vl = bc.value if bc is not None else held
        n, total = 0, np.zeros(n_scalars)
        G = ColumnSums(p, g) if layout == "csr" else np.zeros((p, g))
        for b in it:
            if b.num_rows == 0:
                continue
            for y, M in iter_blocks(b, p, layout, amap):
                scalars, S = rows(y, amap.apply(M, Vl))
                total += scalars
                if g:
                    if layout == "csr":
                        G.add(*amap.adjoint_pairs(M, S))
                    else:
                        G += amap.adjoint(M, S)
                n += len(y)
        if n:
            counts = np.concatenate([[float(n)], total])
            if layout == "csr":
                yield from G.emit(counts)
            else:
                yield emit_blocks(np.concatenate([counts, G.ravel(order="F")]))

    try:
        parts = blocks.mapInArrow(task, PARTIAL_SCHEMA)
        flat = sum_blocks(parts, head + g * p, tasks)
    finally:
        if bc is not None:
            bc.unpersist()
    return int(round(flat[0])), flat[1:head], flat[head:].reshape((p, g), order="F")


class ColumnSums:
    """Sums by (column, gradient) of sparse rows: only the blocks of the partial
    vector that hold one of the task's columns exist and are sent."""

    def __init__(self, p: int, g: int):
        self.p, self.g, self.held = p, g, {}

    def add(self, columns: np.ndarray, values: np.ndarray) -> None:
        at, where = np.unique(columns, return_inverse=True)
        for j in range(self.g):
            flat = at + j * self.p
            sums = np.bincount(where, values[:, j], at.size)
            block = flat // BLOCK
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-2))
            for a, b in zip(cuts[:-1], cuts[1:]):
                into = self.held.setdefault(int(block[a]), np.zeros(BLOCK))
                into[flat[a:b] - block[a] * BLOCK] += sums[a:b]

    def emit(self, head: np.ndarray):
        """Record batches (block, values) of the vector [head, sums]."""
        shift, out = len(head), {0: np.zeros(BLOCK)}
        out[0][:shift] = head
        for block, values in self.held.items():  # the head moves every sum by a few places
            first = block * BLOCK + shift
            for part, lo, hi in ((first // BLOCK, 0, BLOCK - first % BLOCK), (first // BLOCK + 1, BLOCK - first % BLOCK, BLOCK)):
                if lo < hi and values[lo:hi].any():
                    at = first + lo - part * BLOCK
                    out.setdefault(part, np.zeros(BLOCK))[at:at + hi - lo] += values[lo:hi]
        length = shift + self.p * self.g
        rows = [(k, v[:min(BLOCK, length - k * BLOCK)]) for k, v in sorted(out.items()) if k * BLOCK < length]
        offsets = np.concatenate([[0], np.cumsum([len(v) for _, v in rows])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.int32()),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([v for _, v in rows])))],
            names=["block", "v"])


def squared_rows(flags, gidx, loss=None):
    """Row function of ``multi_pass``: cross products of r_j = A v_j - flag_j b and the
    rows whose adjoint is wanted; with a loss, its value and derivative instead."""
    k = len(flags)

    def rows(y, P):
        if loss is not None:
            one = np.array([2.0 * loss_value(loss, P[:, 0], y)])
            return one, loss_derivative(loss, P[:, 0], y)[:, None] if len(gidx) else None
        R = P - np.outer(y, flags)
        return (R.T @ R).ravel(), R[:, gidx]

    return rows, k * k


def loss_value(loss, a: np.ndarray, b: np.ndarray) -> float:
    """Loss of predictions ``a`` for labels ``b``: ``value_rows(a, b)`` if the plug-in
    has it, else ``value_np`` of the residuals."""
    return loss.value_rows(a, b) if hasattr(loss, "value_rows") else loss.value_np(a - b)


def loss_derivative(loss, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return loss.derivative_rows(a, b) if hasattr(loss, "derivative_rows") else loss.derivative_np(a - b)


def multi_pass(design: DataFrame, p: int, V: np.ndarray, use_label, grad_for=(),
               label: str = "label", features: str = "features",
               tasks: int | None = None, blocked: bool = False, loss=None) -> PassResult:
    """One scan: for the columns v_j of V (p x k) the residuals
    ``r_j = A v_j - flag_j b`` give all inner products r_j . r_l (so the half
    squared norms), and for j in ``grad_for`` the gradients ``A^T r_j``.

    With ``loss`` (one column only) the loss and its gradient at that column;
    there are no inner products then."""
    k = np.asarray(V).reshape(p, -1).shape[1]
    if loss is not None and k != 1:
        raise ValueError("a loss plug-in is evaluated for one coefficient vector at a time")
    flags = np.asarray(use_label, dtype=np.float64).reshape(k)
    gidx = [int(j) for j in grad_for]
    rows, scalars = squared_rows(flags, gidx, loss)
    src = design if blocked else design.select(F.col(label).cast("double"), F.col(features))
    n, C, G = row_pass(src, p, V, rows, scalars, len(gidx), "blocks" if blocked else "rows", tasks=tasks)
    C = C.reshape(k, k)
    C = 0.5 * (C + C.T)
    return PassResult(n, 0.5 * np.diag(C).copy(), G, C)


@dataclass
class GramResult:
    n: int
    bb: float               # b.b
    c: np.ndarray           # A^T b
    G: np.ndarray           # A^T A


def gram_pass(design: DataFrame, p: int, label: str = "label",
              features: str = "features", tasks: int | None = None,
              blocked: bool = False, validate: bool = True) -> GramResult:
    """One scan for A^T A, A^T b, b^T b, n (P14), checking every value on the
    way. Task partials are p^2 + p + 2 doubles, so callers keep p small
    (``FitConfig.gram_max_p``)."""

    ship_package(design.sparkSession)
    def task(it):
        single_thread_blas()
        G = np.zeros((p, p))
        c = np.zeros(p)
        bb = 0.0
        n = 0
        for b in it:
            if b.num_rows == 0:
                continue
            try:
                pieces = list(iter_xy(b, p, blocked, validate and not blocked))
            except ValueError as e:
                msg = str(e)
                raise ValueError(msg if msg.startswith(INVALID) else f"{INVALID} {msg}") from None
            for y, M in pieces:
                G += M.T @ M
                c += M.T @ y
                bb += float(y @ y)
                n += len(y)
        if n:
            yield emit_blocks(np.concatenate([[float(n), bb], c, G.ravel()]))

    src = design if blocked else design.select(F.col(label).cast("double"), F.col(features))
    parts = src.mapInArrow(task, PARTIAL_SCHEMA)
    flat = sum_blocks(parts, 2 + p + p * p, tasks)
    G = flat[2 + p:].reshape(p, p)
    return GramResult(int(round(flat[0])), float(flat[1]), flat[2:2 + p], 0.5 * (G + G.T))


def predict(design: DataFrame, w: np.ndarray, features: str = "features",
            out: str = "prediction") -> DataFrame:
    """Row-level A.w appended as a column (O16, Arrow form): the weights go out
    as one broadcast, rows stay where they are (no shuffle)."""
    ship_package(design.sparkSession)
    w = np.ascontiguousarray(np.asarray(w, dtype=np.float64).ravel())
    p = len(w)
    _check_broadcast(w.nbytes)
    bc = design.sparkSession.sparkContext.broadcast(w)
    names = design.columns
    fidx = names.index(features)
    schema = T.StructType(design.schema.fields + [T.StructField(out, T.DoubleType(), True)])

    def task(it):
        single_thread_blas()
        wl = bc.value
        for b in it:
            pred = features_matrix(b.column(fidx), p) @ wl if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(pred, pa.float64())],
                                             names=list(b.schema.names) + [out])

    return design.mapInArrow(task, schema)
