"""Sharding by a Feistel permutation with cycle walking over global row
numbers (DataFrame functions only).

Law ``rows``: documents are numbered 0..n-1 in the order (doc_id, text CRC,
size), nulls last; the number goes through a keyed permutation of [0, n); the
permuted place p gives shard ``p mod shards`` and slot ``p div shards``. Shard
counts differ by at most one, slots are gapless from 0, and the place of any
row is computable from its number, n and the seed alone (and the number from
the place by the inverse permutation).

The permutation works on the grid a x b with a = ceil(sqrt(n)) and
b = ceil(n / a): a place is (left, right) = (x div b, x mod b), and rounds
alternately add a keyed hash of one half to the other, modulo its size. The
grid has fewer than a places too many; a place at or above n walks on through
the permutation until it falls below n.

Row numbers need no single-task sort: rows are cut into sorted ranges of similar
row counts, numbered within them, and the ranges' counts (one row per range) are
summed up. Only (doc_id, size, CRC) are shuffled, never texts.

A null text has size 1 and the CRC of the empty text. Repeated rows get a
place each. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penfit.llm.common import pick, prefix_of_buckets, stage

SHARDS = 16
SEED = 20240229
ROUNDS = 4
#: Fixed values of the round hash: multiplier, increment and prime modulus of
#: a linear step, small enough for exact 64-bit products after a reduction.
MUL, ADD, PRIME = 48271, 12820163, 2147483647


def _round_hash(x: Column, key: int) -> Column:
    """0 <= hash < 2**31 - 1 of a half-place (halves stay below 2**31 for up to
    2**62 rows). Linear, square, linear; every product stays below 2**62."""
    p = F.lit(PRIME).cast("bigint")  # % of numbers that are never negative
    y = (x * MUL + (key * 7919 + ADD) % PRIME) % p
    return ((y * y + (key * 104729 + 7) % PRIME) % p * MUL + key) % p


def grid(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    out, k = [], seed % PRIME
    for _ in range(rounds):
        k = (k * MUL + ADD) % PRIME
        out.append(k)
    return out


def once(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """``df`` with ``column`` moved one step by the grid's permutation. A
    projection per round, so that no half is computed twice."""
    a, b = grid(n)
    rest = [c for c in df.columns if c != column]
    df = df.select(*rest, F.floor(F.col(column) / F.lit(b)).cast("bigint").alias("_left"),
                   (F.col(column) % F.lit(b).cast("bigint")).alias("_right"))
    for i, key in enumerate(round_keys(seed)):
        left, right = F.col("_left"), F.col("_right")
        if i % 2 == 0:
            left = (left + _round_hash(F.col("_right"), key)) % F.lit(a).cast("bigint")
        else:
            right = (right + _round_hash(F.col("_left"), key)) % F.lit(b).cast("bigint")
        df = df.select(*rest, left.alias("_left"), right.alias("_right"))
    return df.select(*rest, (F.col("_left") * F.lit(b) + F.col("_right")).alias(column))


def surplus_walk(spark: SparkSession, n: int, seed: int = SEED) -> DataFrame:
    """(_from, _to): the surplus places of the grid, those at or above n, and the
    first place below n on each one's walk. Fewer than sqrt(n) + 1 rows.

    Pointer jumping: an open entry takes the entry of the place it stands on, so
    a walk of any length ends after log2 of it rounds, each on a written table.
    Surplus places that form a cycle of their own never leave it; no row lands on
    one (its predecessor would be a surplus place too), so they are left out. They
    are all that is open once a round closes no entry: as long as a walk is not
    closed, the places one jump from its end close in that round.
    """
    a, b = grid(n)
    walk = once(spark.range(n, a * b, 1, 1).select(F.col("id").alias("_from"), F.col("id").alias("_to")),
                "_to", n, seed)
    walk = stage(walk, "shard-walk")
    left, before = walk.where(F.col("_to") >= n).count(), None
    while left and left != before:
        jump = walk.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        walk = stage(walk.join(F.broadcast(jump), "_to", "left")  # fewer than sqrt(n) + 1 rows
                     .select("_from", F.coalesce("_next", "_to").alias("_to")), "shard-walk")
        left, before = walk.where(F.col("_to") >= n).count(), left
    return walk.where(F.col("_to") < n)


def permuted(df: DataFrame, column: str, n: int, seed: int = SEED, out: str = "place") -> DataFrame:
    """``df`` with ``out``, the image of ``column`` under the keyed
    permutation of [0, n): one step of the grid's permutation, and the end of the
    walk (``surplus_walk``) for rows that it puts at or above n."""
    moved = df.withColumn(out, F.col(column).cast("bigint"))
    if n <= 1:
        return moved
    a, b = grid(n)
    moved = once(moved, out, n, seed)
    if a * b == n:
        return moved
    walk = surplus_walk(df.sparkSession, n, seed)
    return (moved.join(F.broadcast(walk), F.col(out) == F.col("_from"), "left")
            .withColumn(out, F.coalesce("_to", out)).drop("_from", "_to"))


def numbered(rows: DataFrame, order: list[str], parts: int, out: str = "row_number") -> DataFrame:
    """``rows`` with ``out``, the global row number (from 0) in the given order,
    nulls last; rows equal in all these columns are interchangeable.

    Rows are range-partitioned by all columns of the order and a row tag, so an id,
    or a copied row, with a large share of the table is cut into several ranges.
    Each task sorts and numbers its range; the written ranges' counts (one row per
    range) are summed up."""
    keys = [F.col(c).asc_nulls_last() for c in order]
    tagged = rows.withColumn("_tag", F.monotonically_increasing_id())
    ranged = tagged.repartitionByRange(parts, *keys, F.col("_tag")).sortWithinPartitions(*keys, "_tag")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stage(ranged.select(*rows.columns, F.spark_partition_id().alias("_range"), within.alias("_within")),
                   "numbered")
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_held"))
    starts = prefix_of_buckets(totals, "_range", "_held", "_before").select("_range", "_before")
    return (ranged.join(F.broadcast(starts), "_range")  # one row per range
            .withColumn(out, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before"))


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
               text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this
    law), row_number and place, one row per input row."""
    got = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    small = stage(got.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32")), "shard-rows")
    n = small.count()
    if parts is None:
        parts = max(8, n // 500_000)
    rows = numbered(small, ["doc_id", "text_crc32", "size"], parts)
    placed = permuted(rows, "row_number", n, seed)
    slot = (F.col("place") - F.pmod("place", F.lit(shards))) / F.lit(shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                         F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
                         slot.cast("bigint").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "row_number", "place")
