"""Token ids in Parquet list columns.

A token table is a folder with two Parquet tables:

* ``tokens``: part, doc_id, start_in_part, n_tokens, tokens (list of int32).
  Documents are in ascending doc_id order (ties by text hash, null ids last),
  one file per ``part``, a range of doc_ids. Row groups and pages are small and
  carry page indexes (offset and column index), so a filter on doc_id or
  start_in_part reads only the pages it needs, and a read of the metadata
  columns never touches the token pages. ``tokens`` is encoded with a dictionary
  (``encoding="dictionary"``) or as packed deltas (``"delta"``); the metadata
  columns are always packed deltas.
* ``parts``: part, first_id, last_id, documents, tokens_held, base (ids of all
  parts before). A document's ``start`` is base + start_in_part.

Every document ends with ``end_id``; a null or empty text has that id alone.
Rows with the same doc_id are separate documents. Other columns are ignored.
Spark's writer commits the files, so a lost executor's task is simply rerun.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penfit.llm.common import pick, prefix_of_buckets, unique_path
from penfit.llm.tokens import WORD_BPE, encoder, tokenizer_path

END_ID = 2
DOCS_PER_PART = 8_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1_000


def _encode_part(path: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        enc, part, at = encoder(path), None, 0
        for b in batches:
            row = 0
            # runs of texts of a bounded size bound the ids held at once
            for n, ids, offsets in enc.encode_column(b.column(2)):
                s, row = b.slice(row, n), row + n
                made = np.insert(ids, offsets[1:], end_id)
                offsets = offsets + np.arange(n + 1)
                sizes, starts, parts = np.diff(offsets), offsets[:-1] + at, s.column(0).to_numpy()
                for k in np.flatnonzero(np.append(parts[0] != part, parts[1:] != parts[:-1])):
                    starts[k:] = offsets[k:-1] - offsets[k]
                part, at = parts[-1], int(starts[-1] + sizes[-1])
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(made.view("<i4")))],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "tokens"])
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES,
                 page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS,
                 docs_per_part: int = DOCS_PER_PART, id_col: str = "doc_id",
                 text_col: str = "text") -> str:
    """Write the token table of ``docs`` at ``path`` (a new folder)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding {encoding!r}: 'dictionary' or 'delta'")
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path(WORD_BPE)
    got = pick(docs, doc_id=id_col, text=text_col)
    parts = max(1, -(-got.count() // docs_per_part))
    # one task and file per sorted range of (id, text hash, row tag): an id, or a copied
    # row, with many rows is cut into several ranges
    tagged = got.withColumns({"_hash": F.xxhash64("text"), "_tag": F.monotonically_increasing_id()})
    keys = [F.col("doc_id").asc_nulls_last(), F.col("_hash"), F.col("_tag")]
    dealt = (tagged.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
             .withColumn("part", F.spark_partition_id()))
    made = dealt.select("part", "doc_id", "text").mapInArrow(
        _encode_part(tokenizer, end_id),
        "part int, doc_id bigint, start_in_part bigint, n_tokens bigint, tokens array<int>")
    plain = ("part", "doc_id", "start_in_part", "n_tokens")
    out = (made.write.option("compression", "zstd")
           .option("parquet.writer.version", "PARQUET_2_0")
           .option("parquet.block.size", str(row_group_bytes))
           .option("parquet.page.size", str(page_bytes))
           .option("parquet.page.row.count.limit", str(page_rows))
           .option("parquet.enable.dictionary", "true" if encoding == "dictionary" else "false"))
    for c in plain:
        out = out.option(f"parquet.enable.dictionary#{c}", "false")
    out.parquet(f"{path}/tokens")
    meta = spark.read.parquet(f"{path}/tokens").groupBy("part").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens_held"))
    prefix_of_buckets(meta, "part", "tokens_held", "base").coalesce(1).write.parquet(f"{path}/parts")
    return path


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; token pages are not read."""
    rows = spark.read.parquet(f"{path}/tokens").select("part", "doc_id", "start_in_part", "n_tokens")
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens")


def read_documents(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, tokens of all or of the named documents (the
    id filter reaches the page index)."""
    rows = spark.read.parquet(f"{path}/tokens")
    if ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(ids)))
    return _with_start(spark, path, rows).select("doc_id", "start", "n_tokens", "tokens")


def read_tokens(spark: SparkSession, path: str, first: int, count: int) -> DataFrame:
    """(doc_id, start, tokens) pieces that hold the ids first .. first+count-1
    of the whole stream, cut to that range, in order of ``start``."""
    parts = spark.read.parquet(f"{path}/parts").where(
        (F.col("base") < first + count) & (F.col("base") + F.col("tokens_held") > first))
    rows = _with_start(spark, path, spark.read.parquet(f"{path}/tokens"), parts)
    end = F.col("start") + F.col("n_tokens")
    rows = rows.where((F.col("start") < first + count) & (end > first))
    lo = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    hi = F.least(F.lit(first + count) - F.col("start"), F.col("n_tokens"))
    return rows.select("doc_id", (F.col("start") + lo).alias("start"),
                       F.slice("tokens", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("tokens"))


def _with_start(spark, path, rows, parts=None):
    parts = spark.read.parquet(f"{path}/parts") if parts is None else parts
    bases = parts.select("part", "base")  # one row per file
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part"))


def _digest(batches):
    import pyarrow as pa
    for b in batches:
        lists = b.column(3)
        off = lists.offsets.to_numpy()
        raw = lists.values.to_numpy(zero_copy_only=True).astype("<u4", copy=False)
        crc = [zlib.crc32(raw[off[i]:off[i + 1]]) for i in range(len(lists))]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers) of rows from :func:`read_documents`."""
    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(
        _digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_token_path(spark: SparkSession) -> str:
    return unique_path(spark, "token-files")
