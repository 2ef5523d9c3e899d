"""Lexical retrieval packing: a sharded BM25 index returns unused neighbours
for each seed document, which greedily fill its window.

1. Every text is tokenised once, its end id appended, and written with its
   ids to the shared folder; the same scan counts, per task, in how many
   documents each id occurs. The counts of all documents (one vector of
   vocabulary length) give the index its inverse document frequencies.
2. Documents are placed by their telling words (``placement.py``; the tree comes
   from a bounded sample before the scan), and a shard is a run of places with
   ``shard_tokens`` ids at most, so texts that share words share an index, and a
   shard's index has the same size for any input. A shard is the unit that is
   retried when an executor is lost. A seed sees its own shard only: see the
   README for the share of all documents' best neighbours that lie there.
3. Inside a shard, whole windows are cut off documents that are longer than a
   window. The remainders are indexed: postings by id with BM25 weights. A seed
   (the longest unused remainder, or what a cut left over) is looked up by its
   ``query_terms`` most telling ids; its unused neighbours, best first, go into the
   window while they fit whole (``neighbours`` at a time, down to the last one
   with a score); then the best one left is cut to fill it and what is left of it
   is the next seed. Documents without a score come only after that. So only the
   last sequence of a shard is padded.

Every id of every document lies in exactly one piece. A null or empty text is
its end id alone. Rows with the same doc_id are packed on their own. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penfit.llm import placement
from penfit.llm.common import pick, unique_path
from penfit.llm.tokens import BYTE_BPE, encoder, tokenizer_path

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 21
QUERY_TERMS = 24
NEIGHBOURS = 48
K1, B = 1.2, 0.75

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def _ended(enc, column, end_id: int, most: int = 512):
    """Ids of each text with its end id, for runs of at most ``most`` texts of a column."""
    for n, ids, offsets in enc.encode_column(column):
        for lo in range(0, n, most):
            at = offsets[lo:lo + most + 1] - offsets[lo]
            held = np.insert(ids[offsets[lo]:offsets[lo] + at[-1]], at[1:], end_id)
            yield np.split(held, at[1:-1] + np.arange(1, at.size - 1))


def _sample(path: str, end_id: int, window: int):
    """(ids, counts) of the remainder of each text."""
    def run(batches):
        import pyarrow as pa
        enc = encoder(path)
        for b in batches:
            made = [np.unique(ids[ids.size // window * window:], return_counts=True)
                    for texts in _ended(enc, b.column(0), end_id) for ids in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.astype("<u4").tobytes() for x, _ in made], pa.binary()),
                 pa.array([c.astype("<u4").tobytes() for _, c in made], pa.binary())], names=["ids", "counts"])
    return run


def placing_tree(docs: DataFrame, tokenizer: str, end_id: int, window: int, shard_tokens: int):
    """Tree of a sample of (doc_id, text); None if all ids fit into one shard (a
    text has no more ids than bytes, and its end id)."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n + size <= shard_tokens:
        return None
    want = min(placement.SAMPLE, placement.SAMPLE_PER_SHARD * -(-(n + size) // (4 * shard_tokens)))
    key = F.xxhash64(F.lit(3), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    rows = docs.where(F.pmod(key, F.lit(1 << 30)) < max(1, min(1 << 30, (want << 30) // n)))
    rows = rows.dropDuplicates(["doc_id", "text"]).select("text")
    got = rows.mapInArrow(_sample(tokenizer, end_id, window), "ids binary, counts binary").toArrow()
    pairs = sorted(zip(got.column("ids").to_pylist(), got.column("counts").to_pylist(), strict=True))
    return placement.Tree([(np.frombuffer(a, "<u4"), np.frombuffer(c, "<u4")) for a, c in pairs if a],
                          max(encoder(tokenizer).library.get_vocab_size(), end_id + 1))


def _encode(path: str, end_id: int, window: int, tree):
    def run(batches):
        import pyarrow as pa
        enc = encoder(path)
        size = max(enc.library.get_vocab_size(), end_id + 1)
        narrow = "<u2" if size <= 1 << 16 else "<u4"
        df = np.zeros(size, np.int64)
        names = ["doc_id", "n", "ids", "leaf", "cell", "counts"]
        placed = tree.value if tree is not None else None
        for b in batches:
            row = 0
            for texts in _ended(enc, b.column(1), end_id):
                s, row = b.slice(row, len(texts)), row + len(texts)
                n, made, rest = [], [], []
                for ids in texts:
                    terms, counts = np.unique(ids, return_counts=True)
                    df[terms] += 1
                    if placed is not None:
                        whole = ids.size // window * window
                        rest.append(np.unique(ids[whole:], return_counts=True) if whole else (terms, counts))
                    n.append(ids.size)
                    made.append(ids.astype(narrow).tobytes())
                leaf, cell = placed.places(rest) if placed is not None else (np.zeros((2, len(n)), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), pa.array(n, pa.int64()), pa.array(made, pa.binary()), pa.array(leaf, pa.int32()),
                     pa.array(cell, pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays(
            [pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()),
             pa.array([None], pa.int32()), pa.array([None], pa.int32()),
             pa.array([df.astype("<i8").tobytes()], pa.binary())], names=names)
    return run


def _add_counts(batches):
    import pyarrow as pa
    total = None
    for b in batches:
        for v in b.column(0):
            got = np.frombuffer(v.as_py(), "<i8")
            total = got.copy() if total is None else total + got
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])


class Index:
    """BM25 postings of one shard's remainders, by id."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray):
        terms, tfs = [], []
        for ids in items:
            t, c = np.unique(ids, return_counts=True)
            terms.append(t)
            tfs.append(c.astype(np.int32))
        sizes = np.array([len(x) for x in items], np.float32)
        mean = sizes.mean() if len(items) else np.float32(1.0)
        # 32-bit numbers: a shard has at most a few million postings
        item = np.repeat(np.arange(len(items), dtype=np.int32), [t.size for t in terms])
        term = np.concatenate(terms).astype(np.int32)
        tf = np.concatenate(tfs).astype(np.float32)
        long = (np.float32(K1 * (1 - B)) + np.float32(K1 * B) * sizes / mean)[item]
        weight = idf.astype(np.float32)[term] * tf * np.float32(K1 + 1) / (tf + long)
        order = np.argsort(term, kind="stable")
        self.item, self.weight = item[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(idf.size + 1, dtype=np.int32))
        self.idf, self.n = idf, len(items)

    def scores(self, ids: np.ndarray, terms: int) -> np.ndarray:
        t, c = np.unique(ids, return_counts=True)
        if t.size > terms:
            value = self.idf[t] * (c / (c + K1))
            t = t[np.argsort(-value, kind="stable")[:terms]]
        lo, hi = self.begin[t], self.begin[t.astype(np.int64) + 1]
        lists = [slice(a, b) for a, b in zip(lo.tolist(), hi.tolist())] or [slice(0)]
        return np.bincount(np.concatenate([self.item[x] for x in lists]),
                           np.concatenate([self.weight[x] for x in lists]), self.n)


def ranked(score: np.ndarray, first: int):
    """Items with a score, best first; the next ones are sorted when asked for."""
    rest = np.flatnonzero(score > 0)
    while rest.size:
        now, rest = rest, rest[:0]
        if now.size > first:
            part = np.argpartition(-score[now], first - 1)
            now, rest = now[part[:first]], now[part[first:]]
        yield from now[np.lexsort((now, -score[now]))].tolist()
        first *= 4


def fill_windows(items: list[np.ndarray], idf: np.ndarray, window: int = WINDOW,
                 terms: int = QUERY_TERMS, neighbours: int = NEIGHBOURS) -> list[list[tuple]]:
    """Sequences of (item, from, to) over remainders shorter than a window.
    Every id of every item is in one piece; all but the last sequence are full."""
    if not items:
        return []
    index = Index(items, idf)
    size = np.array([x.size for x in items])
    unused = np.ones(len(items), bool)
    order = np.argsort(-size, kind="stable")
    out, at, carry = [], 0, None
    while True:
        if carry is None:
            while at < len(order) and not unused[order[at]]:
                at += 1
            if at == len(order):
                return out
            seed, begin = int(order[at]), 0
        else:
            seed, begin = carry
        unused[seed], carry = False, None
        seq = [(seed, begin, int(size[seed]))]
        room = window - (int(size[seed]) - begin)
        if room > 0:
            score = index.scores(items[seed], terms)
            score[~unused] = -1.0
            left = []
            for k, i in enumerate(ranked(score, neighbours)):
                if k >= neighbours and left:
                    break
                if size[i] <= room:
                    seq.append((i, 0, int(size[i])))
                    unused[i] = False
                    room -= int(size[i])
                else:
                    left.append(i)
                if room == 0:
                    break
            while room > 0:  # cut the best neighbour left, else take the next unused one
                if left:
                    i = left.pop(0)
                else:
                    while at < len(order) and not unused[order[at]]:
                        at += 1
                    if at == len(order):
                        break
                    i = int(order[at])
                unused[i] = False
                take = min(room, int(size[i]))
                seq.append((i, 0, take))
                room -= take
                if take < size[i]:
                    carry = (i, take)
        out.append(seq)


def pack_shard(ids: list, docs: list[np.ndarray], idf: np.ndarray, window: int = WINDOW):
    """(doc index, start, length, sequence, offset) of every piece."""
    pieces, seqs, rest, owner = [], 0, [], []
    for d, x in enumerate(docs):
        whole = x.size // window
        for k in range(whole):
            pieces.append((d, k * window, window, seqs, 0))
            seqs += 1
        if x.size % window:
            rest.append(x[whole * window:])
            owner.append((d, whole * window))
    for seq in fill_windows(rest, idf, window):
        offset = 0
        for item, a, b in seq:
            d, base = owner[item]
            pieces.append((d, base + a, b - a, seqs, offset))
            offset += b - a
        seqs += 1
    return pieces


def _pack(idf_bytes, window: int, wide: bool):
    def run(key, table):
        import pyarrow as pa
        encoder.cache_clear()  # this worker encodes no more: its caches make room for the shard
        idf = np.frombuffer(idf_bytes.value, "<f8")
        shard = key[0].as_py()
        kind = "<u4" if wide else "<u2"
        # one order for equal shards, whatever order the rows arrive in
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist(), strict=True),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ids = [r[0] for r in rows]
        docs = [np.frombuffer(r[1], kind) for r in rows]
        del rows, table  # the arrays hold their bytes
        got = pack_shard(ids, docs, idf, window)
        crc = [zlib.crc32(docs[d][a:a + n].astype("<u4")) for d, a, n, _, _ in got]
        cols = list(zip(*got)) if got else [[]] * 5
        return pa.table({
            "doc_id": pa.array([ids[d] for d in cols[0]], pa.int64()),
            "start": pa.array(cols[1], pa.int64()), "length": pa.array(cols[2], pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array([docs[d].size for d in cols[0]], pa.int64()),
            "sequence_id": pa.array([(shard << 32) + s for s in cols[3]], pa.int64()),
            "offset": pa.array(cols[4], pa.int64())})
    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID,
                   window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of
    every piece. ``sequence_id`` is shard * 2**32 + number in the shard."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path(BYTE_BPE)
    size = max(encoder(tokenizer).library.get_vocab_size(), end_id + 1)
    wide = size > 1 << 16
    got = pick(docs, doc_id=id_col, text=text_col)
    tree = placing_tree(got, tokenizer, end_id, window, shard_tokens)
    path = unique_path(spark, "packing-ids")
    schema = "doc_id bigint, n bigint, ids binary, leaf int, cell int, counts binary"
    sent = spark.sparkContext.broadcast(tree) if tree is not None else None
    got.mapInArrow(_encode(tokenizer, end_id, window, sent), schema).write.option(
        "compression", "zstd").parquet(path)
    made = spark.read.schema(schema).parquet(path)
    counts = made.where("counts is not null").select("counts")
    # one vector per task -> 8 vectors -> the driver (vocabulary length each)
    vectors = [np.frombuffer(r[0], "<i8") for r in
               counts.repartition(8).mapInArrow(_add_counts, "counts binary").collect()]
    df = sum(vectors) if vectors else np.zeros(size, np.int64)
    held = made.where("counts is null")
    # at most leaves of the tree x CELLS rows
    cells = [tuple(r) for r in held.groupBy("leaf", "cell").agg(F.sum("n"), F.count("*")).collect()]
    n = sum(c[3] for c in cells)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    dealt = spark.createDataFrame(placement.deal([c[:3] for c in cells], shard_tokens),
                                  "leaf int, cell int, first int, shards int")
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("ids")))
    shard = (F.col("first") + F.pmod(key, F.col("shards"))).cast("bigint")
    shared = spark.sparkContext.broadcast(idf.astype("<f8").tobytes())
    return (held.join(F.broadcast(dealt), ["leaf", "cell"]).select(shard.alias("shard"), "doc_id", "ids")
            .groupBy("shard").applyInArrow(_pack(shared, window, wide), PIECES))
