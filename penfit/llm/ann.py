"""Nearest neighbours by inner product with an adaptive dimension scan.

* Fit: k-means on at most ``fit_rows`` vectors (taken by a hash of vec_id) gives
  the lists; a random rotation (seeded, orthogonal) spreads every vector's
  energy over all dimensions. Every vector is indexed.
* Index: vectors go to the list of their nearest centroid. A list with more than
  ``chunk_rows`` vectors is cut into chunks by a hash of vec_id, so a list that
  holds a third of all rows is many even chunks. A chunk stores its rotated
  vectors in blocks of ``block`` columns.
* Search: each query probes a share of the lists, nearest first, all their
  chunks. (The share is high because vectors without clusters need it: on
  isotropic data in 64 dimensions half of the lists hold 0.9 of the neighbours.)
  The first lists give a query's bar, its 20th inner product so far. In a chunk the partial squared distance of all candidates grows block by block.
  After m of D dimensions the estimate (D / m) * partial is tested against the
  distance that the bar stands for (d2 = |q|2 + |x|2 -
  2 ip): a candidate is abandoned when partial > limit * m/D * (1 + eps/sqrt(m))**2,
  which rejects a true neighbour with a probability that falls fast with eps.
  Survivors get the exact inner product of the original vectors.
* The other lists are searched in cells: lists side by side, or a chunk of a long one,
  up to ``CELL_ROWS`` rows. A query goes to a cell once, with a bit for each list that it
  probes there, not once for each list; its bar rises from list to list. So no row and no
  batch holds a vector for each of the probed lists, whose number grows with the table.
* The best 20 of every (query, chunk or cell) meet per query.

Order: inner product descending, then vec_id. Vectors that are null, zero, of
another length than most, or hold null or non-finite components take no part,
neither as queries nor as candidates. Rows with the same vec_id are separate
candidates (a query leaves out all rows with its own vec_id) and one query, the
smallest of their vectors. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penfit.llm.common import pick, stage

NEIGHBOURS = 20
FIT_ROWS = 32_768
LIST_ROWS = 256
MAX_LISTS = 4096
PROBE_SHARE = 0.65
FIRST_PROBES = 4
MIN_PROBES = 16
CHUNK_ROWS = 2048
QUERY_ROWS = 8192
CELL_ROWS = 65_536
CELLS = 32
BLOCK = 16
EPS = 2.1
SEED = 5
#: Rows whose distances to all centroids are held at once (16 MB at MAX_LISTS).
SLICE = 512


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = pick(vectors, vec_id=id_col, v=vec_col)
    good = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("v", lambda x: x != 0))
    kind = "float" if v.schema["v"].dataType.simpleString() == "array<float>" else "double"  # floats are half the bytes
    return v.where(good).select(F.col("vec_id").cast("bigint"), F.col("v").cast(f"array<{kind}>").alias("v"))


def kmeans(x: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        held = np.bincount(near, minlength=len(c))
        c[held > 0] = total[held > 0] / held[held > 0, None]
        empty = np.flatnonzero(held == 0)
        if empty.size:
            c[empty] = x[rng.choice(len(x), empty.size)]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = 0.5 * (c * c).sum(1)
    for lo in range(0, len(x), 4096):
        out[lo:lo + 4096] = (x[lo:lo + 4096] @ c.T - half).argmax(1)
    return out


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64, copy=False)


def _assign(centroids: np.ndarray, dims: int):
    """(list, vec_id, v): each vector in its nearest list."""
    def run(batches):
        import pyarrow as pa
        half = 0.5 * (centroids * centroids).sum(1)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                near = (half - _matrix(s.column(1), dims) @ centroids.T).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), s.column(0), s.column(1)],
                                                 names=["list", "vec_id", "v"])
    return run


def _probe(centroids: np.ndarray, dims: int, first: int, probes: int):
    """(vec_id, v, near, late): the ``first`` nearest lists of a query, and a bit for
    each list: whether it is among the other probed ones."""
    def run(batches):
        import pyarrow as pa
        half = 0.5 * (centroids * centroids).sum(1)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                far = half - _matrix(s.column(1), dims) @ centroids.T
                best = np.argsort(far, axis=1, kind="stable")[:, :probes]
                late = np.zeros(far.shape, bool)
                np.put_along_axis(late, best[:, first:], True, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(list(best[:, :first].astype(np.int32)), pa.list_(pa.int32())),
                     pa.array([x.tobytes() for x in np.packbits(late, axis=1)], pa.binary())],
                    names=["vec_id", "v", "near", "late"])
    return run


def cells_of(rows: np.ndarray, cell_rows: int) -> tuple[np.ndarray, np.ndarray, list]:
    """First cell and number of cells of every list, and the lists of every cell, of lists
    of ``rows`` rows. Lists share a cell up to ``cell_rows`` rows; a longer one has cells
    of its own."""
    first, count, cells, room = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), [], -1
    for i, n in enumerate(rows.tolist()):
        if n > cell_rows:
            first[i], count[i], room = len(cells), -(-n // cell_rows), -1
            cells += [[i]] * int(count[i])
            continue
        if n > room:
            cells.append([])
            room = cell_rows
        first[i], room = len(cells) - 1, room - n
        cells[-1].append(i)
    return first, count, cells


def _to_cells(cells: list, lists: int):
    """(cell, vec_id, v, bar, asks): a query once for each cell that has a list it probes;
    asks: a bit for each list of the cell."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                s = b.slice(lo, SLICE)
                late = np.frombuffer(b"".join(s.column(2).to_pylist()), np.uint8).reshape(s.num_rows, -1)
                late = np.unpackbits(late, axis=1, count=lists).astype(bool)
                for c, own in enumerate(cells):
                    asks = late[:, own]
                    rows = np.flatnonzero(asks.any(1))
                    if rows.size == 0:
                        continue
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(rows.size, c, np.int32)), s.column(0).take(at), s.column(1).take(at),
                         s.column(3).take(at), pa.array([x.tobytes() for x in np.packbits(asks[rows], axis=1)], pa.binary())],
                        names=["cell", "vec_id", "v", "bar", "asks"])
    return run


def scan_chunk(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, bars: np.ndarray,
               turn: np.ndarray, k: int = NEIGHBOURS, block: int = BLOCK, eps: float = EPS):
    """Best ``k`` of the chunk for every query, at or above its bar, as arrays
    (query, vec_id, score). Scores are exact inner products.

    Queries go in groups of 256, so a chunk's partial distances are bounded by
    256 x the chunk's rows. Columns and rows without a pair left are dropped.
    """
    dims = x.shape[1]
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    rot, qrot = x @ turn, q @ turn
    norms, qnorms = (x * x).sum(1), (q * q).sum(1)
    spans = [(a, min(a + block, dims)) for a in range(0, dims, block)]
    # partial distances of a block as one product: [-2 x, |x|2, 1] . [q, 1, |q|2]
    part = [(np.column_stack((-2.0 * rot[:, a:b], (rot[:, a:b] ** 2).sum(1), np.ones(len(ids)))),
             np.column_stack((qrot[:, a:b], np.ones(len(qids)), (qrot[:, a:b] ** 2).sum(1)))) for a, b in spans]
    out = []
    for lo in range(0, len(qids), 256):
        rows = np.arange(lo, min(lo + 256, len(qids)))
        cols = np.arange(len(ids))
        partial = np.zeros((rows.size, cols.size))
        alive = ids[None, :] != qids[rows][:, None]
        limit = qnorms[rows][:, None] + norms[None, :] - 2.0 * bars[rows][:, None]
        over = 1e-9 * (1.0 + np.abs(limit))
        for i, (a, b) in enumerate(spans):
            partial += part[i][1][rows] @ part[i][0][cols].T
            slack = 1.0 if b == dims else (1.0 + eps / np.sqrt(b)) ** 2
            alive &= partial <= limit * ((b / dims) * slack) + over
            some_col, some_row = alive.any(0), alive.any(1)
            if some_col.mean() < 0.7 or some_row.mean() < 0.7:
                keep = np.ix_(some_row, some_col)
                rows, cols = rows[some_row], cols[some_col]
                partial, alive, limit, over = partial[keep], alive[keep], limit[keep], over[keep]
            if not alive.size:
                break
        if not alive.size:
            continue
        if alive.sum() <= 16 * rows.size:  # few pairs: all at once
            r, c = np.nonzero(alive)
            score = np.einsum("ij,ij->i", x[cols[c]], q[rows[r]])
            by = np.lexsort((ids[cols[c]], -score, r))
            r, c, score = r[by], c[by], score[by]
            kept = (np.arange(r.size) - np.searchsorted(r, r) < k) & (score >= bars[rows[r]])
            out.append((qids[rows[r[kept]]], ids[cols[c[kept]]], score[kept]))
            continue
        near = np.where(alive, (qnorms[rows][:, None] + norms[cols][None, :] - partial) / 2, -np.inf)
        for r in range(rows.size):
            held = int(alive[r].sum())
            if held == 0:
                continue
            if held > k:  # everything that may tie with the k-th goes on
                kth = np.partition(near[r], near.shape[1] - k)[-k]
                cand = cols[near[r] >= kth - 1e-9 * (1.0 + abs(kth))]
            else:
                cand = cols[alive[r]]
            score = np.einsum("ij,j->i", x[cand], q[rows[r]])
            best = np.lexsort((ids[cand], -score))[:k]
            best = best[score[best] >= bars[rows[r]]]
            out.append((np.full(best.size, qids[rows[r]]), ids[cand][best], score[best]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(dims: int, k: int, block: int, eps: float, seed: int):
    def run(key, table):
        import pyarrow as pa
        bar = table.column("bar").to_numpy(zero_copy_only=False)
        is_query = ~np.isnan(bar)  # a candidate's bar is NaN
        ids = table.column("vec_id").to_numpy()
        v = _matrix(table.column("v").combine_chunks(), dims)
        cols = scan_chunk(ids[~is_query], v[~is_query], ids[is_query], v[is_query], bar[is_query],
                          rotation(dims, seed), k, block, eps)
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})
    return run


def search_cell(lists: np.ndarray, ids: np.ndarray, x: np.ndarray, own: list, qids: np.ndarray, q: np.ndarray,
                bars: np.ndarray, asks: np.ndarray, turn: np.ndarray, k: int, chunk_rows: int, block: int, eps: float):
    """Best ``k`` of a cell for every query, as ``scan_chunk`` gives them. ``lists``: of each
    candidate; ``asks``: for each query and list of ``own``, whether it probes the list. What
    is found raises a query's bar for the lists after."""
    order = np.argsort(qids)
    qids, q, bars, asks = qids[order], q[order], bars[order].copy(), asks[order]
    order = np.argsort(lists, kind="stable")
    lists, ids, x = lists[order], ids[order], x[order]
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    new: list = []
    waiting = 0

    def merged():
        at, vec, score = (np.concatenate([h, *[n[i] for n in new]]) for i, h in enumerate(held))
        by = np.lexsort((vec, -score, at))
        at, vec, score = at[by], vec[by], score[by]
        place = np.arange(at.size) - np.searchsorted(at, at)
        last = place == k - 1
        bars[at[last]] = np.maximum(bars[at[last]], score[last])
        return [c[place < k] for c in (at, vec, score)]

    for j, name in enumerate(own):
        lo, hi = np.searchsorted(lists, [name, name + 1])
        rows = np.flatnonzero(asks[:, j])
        if rows.size == 0:
            continue
        for a in range(lo, hi, chunk_rows):
            z = min(a + chunk_rows, hi)
            who, vec, score = scan_chunk(ids[a:z], x[a:z], qids[rows], q[rows], bars[rows], turn, k, block, eps)
            new.append((np.searchsorted(qids, who), vec, score))
            waiting += len(vec)
            if waiting > max(100_000, held[0].size):
                held, new, waiting = merged(), [], 0
    held = merged()
    return qids[held[0]], held[1], held[2]


def _search_cell(dims: int, k: int, cells: list, chunk_rows: int, block: int, eps: float, seed: int):
    def run(key, table):
        import pyarrow as pa
        bar = table.column("bar").to_numpy(zero_copy_only=False)
        is_query = ~np.isnan(bar)
        ids = table.column("vec_id").to_numpy()
        v = _matrix(table.column("v").combine_chunks(), dims)
        own = cells[key[0].as_py()]
        asks = np.frombuffer(b"".join(table.column("asks").filter(pa.array(is_query)).to_pylist()), np.uint8)
        asks = np.unpackbits(asks.reshape(int(is_query.sum()), -1), axis=1, count=len(own)).astype(bool) if asks.size \
            else np.zeros((0, len(own)), bool)
        lists = table.column("list").filter(pa.array(~is_query)).to_numpy()
        cols = search_cell(lists, ids[~is_query], v[~is_query], own, ids[is_query], v[is_query], bar[is_query], asks,
                           rotation(dims, seed), k, chunk_rows, block, eps)
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()),
                         "score": pa.array(cols[2], pa.float64())})
    return run


def _chunks(candidates: DataFrame, queries: DataFrame, sizes: DataFrame, query_rows: int) -> DataFrame:
    """Candidates in their chunk, once for each part of their list's queries; queries
    in their part, once for each chunk of a probed list. So a group holds a chunk's rows
    and at most about ``query_rows`` queries, however many of either a list has."""
    asked_of = queries.groupBy("list").agg(F.ceil(F.count("*") / F.lit(query_rows)).cast("int").alias("parts"))
    both = F.broadcast(sizes.join(asked_of, "list"))  # at most MAX_LISTS rows

    def upto(count):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = candidates.join(both, "list").select(
        "list", F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int").alias("chunk"),
        upto("parts").alias("part"), "vec_id", "v", F.lit(float("nan")).alias("bar"))
    asked = queries.join(both, "list").select(
        "list", upto("chunks").alias("chunk"), F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"),
        "vec_id", "v", "bar")
    return own.unionByName(asked)


def search(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, probe_share: float = PROBE_SHARE,
           first_probes: int = FIRST_PROBES, fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS,
           chunk_rows: int = CHUNK_ROWS, query_rows: int = QUERY_ROWS, block: int = BLOCK, eps: float = EPS, seed: int = SEED,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose
    id is divisible by ``every``, among all other rows."""
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vec_col)
    by_size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if by_size is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims, n = by_size["d"], by_size["count"]
    good = good.where(F.size("v") == dims)
    share = min(1.0, fit_rows / n)
    spread = F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = good.where(spread < share) if share < 1 else good  # about fit_rows rows
    fit = sample.orderBy("vec_id").limit(2 * fit_rows).select("v").toArrow()
    x = _matrix(fit.column("v").combine_chunks(), dims)
    lists = int(max(1, min(MAX_LISTS, n // list_rows, len(x) // 8)))
    centroids = kmeans(x, lists, seed=seed)
    probes = min(lists, max(MIN_PROBES, first_probes, -(-int(1000 * probe_share * lists) // 1000)))
    kind = dict(good.dtypes)["v"]
    candidates = stage(good.mapInArrow(_assign(centroids, dims), f"list int, vec_id bigint, v {kind}"), "ann-lists",
                       release=True)
    queries = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stage(queries.mapInArrow(_probe(centroids, dims, first_probes, probes),
                                     f"vec_id bigint, v {kind}, near array<int>, late binary"), "ann-queries", release=True)
    counts = candidates.groupBy("list").count()  # at most MAX_LISTS rows
    sizes = counts.select("list", F.ceil(F.col("count") / F.lit(chunk_rows)).cast("int").alias("chunks"))
    find = _search(dims, k, block, eps, seed)
    schema = "query_id bigint, vec_id bigint, score double"

    def found(queries):
        return _chunks(candidates, queries, sizes, query_rows).groupBy("list", "chunk", "part").applyInArrow(find, schema)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(rows):
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # the nearest lists set each query's bar, which the other lists must pass
    nearest_lists = asked.select(F.explode("near").alias("list"), "vec_id", "v", F.lit(float("-inf")).alias("bar"))
    early = stage(top(found(nearest_lists)), "ann-first", release=True)
    if probes <= first_probes:
        return early.select("query_id", "rank", "vec_id", "score")
    bars = early.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("_bar"))
    bars = bars.groupBy("_q").agg(F.max("_bar").alias("_bar"))
    rows = np.zeros(len(centroids), np.int64)
    for r in counts.collect():
        rows[r["list"]] = r["count"]
    first, count, cells = cells_of(rows, max(list_rows, min(CELL_ROWS, n // CELLS)))
    parts = max(1, -(-asked.count() // (4 * query_rows)))
    late = asked.join(bars, F.col("vec_id") == F.col("_q"), "left").select(
        "vec_id", "v", "late", F.coalesce("_bar", F.lit(float("-inf"))).alias("bar"))
    late = late.mapInArrow(_to_cells(cells, len(centroids)), f"cell int, vec_id bigint, v {kind}, bar double, asks binary")
    late = late.select("cell", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"),
                       F.lit(-1).alias("list"), "vec_id", "v", "bar", "asks")
    places = spark.createDataFrame([(i, int(a), int(m)) for i, (a, m) in enumerate(zip(first, count))],
                                   "list int, first int, count int")
    own = candidates.join(F.broadcast(places), "list").select(
        (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("count")).cast("int")).alias("cell"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "list", "vec_id", "v",
        F.lit(float("nan")).alias("bar"), F.lit(None).cast("binary").alias("asks"))
    late = own.unionByName(late).groupBy("cell", "part").applyInArrow(
        _search_cell(dims, k, cells, chunk_rows, block, eps, seed), schema)
    return top(early.drop("rank").unionByName(late)).select("query_id", "rank", "vec_id", "score")
