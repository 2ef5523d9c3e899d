"""Interaction audit of five document filters, by wide packed counters.

Filters (a document *fails* one if its condition holds; words are maximal runs of
``[^\\x20\\x09-\\x0D]``, case-sensitive): A under 100 words; B 100 * distinct words
< 80 * words; C 100 * ``[A-Z]`` characters > 10 * code points; D holds any of
``#$%&*|``; E its text is that of any smaller doc_id in the table, removed or not.

What a document does at each of the 600 steps (120 orders of five filters)
follows from its mask, the set of filters it fails. A mask is mapped to one big
integer with a 64-bit field for each outcome of each step: kept, removed,
redundant, and the removed ones of good and of toxic quality; five more fields
take the documents that fail a filter alone. Fields add up without carrying into
the next: a field's sum is at most the number of rows, which is below 2**63. Tasks
sum the integers per part, partial sums are added per part, and the sum is
unpacked into the 600 rows of its part. Shapley values are the sums of a filter's
removed fields.

Steps in Spark: one scan makes a narrow table (id, part, mask of A to D, SHA-256 of
the text; equal texts are those of one SHA-256). The smallest id of each hash is
joined back to it; hashes with more than a 1,024th of the rows, so fewer than 1,024
of them, are looked up in a broadcast instead of one join task. Rows are counted
per (id, part, mask) before they meet the labels, so an id with many rows is a few.

Null texts are empty (no words: A fails, C, D and B do not), and so the same text
as empty ones. A null lang is part ''. A row without id never fails E and makes no
other row fail; neither do rows with the same id. Quality and toxicity are those of
the id's labels, 1 if any of its label rows says so; without a label neither. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penfit.llm.common import pick, stage
from penfit.llm.shingles import text_buffers

FILTERS = "ABCDE"
#: Fixed values of the conditions.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SPECIAL = 100, 80, 10, b"#$%&*|"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
MEASURES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
FIELDS = STEPS * len(MEASURES) + len(FILTERS)
FIELD_BITS = 64
HOT_SHARE = 1024
#: Parts whose sums a task holds at once (about 25 kB each).
PARTS_HELD = 512

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(SPECIAL)] = True
_STARTS = np.ones(256, bool)  # bytes that begin a code point
_STARTS[0x80:0xC0] = False


# -- masks ----------------------------------------------------------------------

def masks_of(offsets, data, valid) -> np.ndarray:
    """Bits 0 to 3: the text fails A, B, C, D."""
    n = len(offsets) - 1
    lo = int(offsets[0])
    own = np.asarray(offsets, np.int64) - lo
    used = data[lo:lo + int(own[-1])]

    def held(table):
        total = np.concatenate(([0], np.cumsum(table[used], dtype=np.int64)))
        return total[own[1:]] - total[own[:-1]]
    points, capitals, special = held(_STARTS), held(_CAPITAL), held(_SPECIAL)
    words, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = memoryview(used)
    for i in range(n):
        if valid is None or valid[i]:
            w = bytes(raw[own[i]:own[i + 1]]).split()  # splits at exactly [\x20\x09-\x0D]
            words[i], distinct[i] = len(w), len(set(w))
    if valid is not None:
        for x in (points, capitals, special):
            x[~valid] = 0
    fails = [words < LEAST_WORDS, 100 * distinct < DISTINCT_PERCENT * words,
             100 * capitals > CAPITAL_PERCENT * points, special > 0]
    return sum(f.astype(np.int64) << i for i, f in enumerate(fails))


def _mask_scan(batches):
    for b in batches:
        masks = masks_of(*text_buffers(b.column(3))) if b.num_rows else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(masks.astype(np.int32))],
                                         names=["doc_id", "part", "sha", "mask"])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (bit i: fails the i-th filter), one row per input row."""
    got = pick(docs, doc_id=id_col, text=text_col, part=part_col)
    text = F.coalesce("text", F.lit(""))
    rows = stage(got.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
                            F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), "text")
                 .mapInArrow(_mask_scan, "doc_id bigint, part string, sha binary, mask int"), "audit-masks")
    n = rows.count()
    firsts = stage(rows.groupBy("sha").agg(F.count("*").alias("held"), F.min("doc_id").alias("first_id"))
                   .where("held > 1"), "audit-texts")
    # fewer than HOT_SHARE texts have more than n / HOT_SHARE rows each
    hot = firsts.where(F.col("held") * HOT_SHARE > n).select("sha", F.col("first_id").alias("hot_id"),
                                                            F.lit(True).alias("is_hot"))
    cold = firsts.where(F.col("held") * HOT_SHARE <= n).select("sha", "first_id")
    marked = rows.join(F.broadcast(hot), "sha", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    bit = F.when(copy, 1 << FILTERS.index("E")).otherwise(0)
    some = marked.where("is_hot").select("doc_id", "part", "mask", F.col("hot_id").alias("first_id"))
    rest = marked.where("is_hot is null").join(cold, "sha", "left").select("doc_id", "part", "mask", "first_id")
    return some.unionByName(rest).select("doc_id", "part", F.col("mask").bitwiseOR(bit).alias("mask"))


# -- wide counters --------------------------------------------------------------

def field_vector(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """The 0/1 fields of one document."""
    out = np.zeros(FIELDS, np.uint64)
    of = {m: out[i * STEPS:(i + 1) * STEPS] for i, m in enumerate(MEASURES)}
    for o, order in enumerate(ORDERS):
        gone = False
        for s, letter in enumerate(order):
            step, fails = o * len(FILTERS) + s, bool(mask >> FILTERS.index(letter) & 1)
            if fails and gone:
                of["redundant"][step] = 1
            elif fails:
                gone = True
                of["removed"][step] = 1
                of["good_lost"][step], of["toxic_lost"][step] = good, toxic
            of["kept"][step] = not gone
    alone = [i for i in range(len(FILTERS)) if mask == 1 << i]
    out[STEPS * len(MEASURES) + np.array(alone, np.int64)] = 1
    return out


def packed(fields: np.ndarray) -> int:
    return int.from_bytes(fields.astype("<u8").tobytes(), "little")


def unpacked(total: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(FIELDS * FIELD_BITS // 8, "little"), "<u8").astype(np.int64)


@functools.cache
def wide_counters() -> dict:
    """(mask, good, toxic) -> big integer."""
    return {(m, g, t): packed(field_vector(m, g, t))
            for m in range(1 << len(FILTERS)) for g in (False, True) for t in (False, True)}


def _emit(sums: dict):
    size = FIELDS * FIELD_BITS // 8
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.string()),
         pa.array([v.to_bytes(size, "little") for v in sums.values()], pa.binary())], names=["part", "total"])


def _sum_masks(batches):
    """Partial sums per part of the documents' integers."""
    wide, sums = wide_counters(), {}
    for b in batches:
        for part, mask, good, toxic, rows in zip(*[c.to_pylist() for c in b.columns], strict=True):
            sums[part] = sums.get(part, 0) + rows * wide[mask, good, toxic]
            if len(sums) >= PARTS_HELD:
                yield _emit(sums)
                sums = {}
    if sums:
        yield _emit(sums)


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sum of a part's sums; they are read batch by batch."""
    total = 0
    for b in batches:
        for payload in b.column(1).to_pylist():
            total += int.from_bytes(payload, "little")
    size = FIELDS * FIELD_BITS // 8
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()),
                                      pa.array([total.to_bytes(size, "little")], pa.binary())],
                                     names=["part", "total"])


_OUT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
        "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def _unpack(batches):
    at = np.array([FILTERS.index(c) for order in ORDERS for c in order])
    for b in batches:
        for part, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = unpacked(int.from_bytes(payload, "little"))
            of = {m: f[i * STEPS:(i + 1) * STEPS] for i, m in enumerate(MEASURES)}
            shapley = np.bincount(at, of["removed"], len(FILTERS)) if of["removed"].max() < 2 ** 45 else \
                np.array([sum(of["removed"][at == i].tolist()) for i in range(len(FILTERS))])
            cols = [pa.array([part] * STEPS, pa.string()),
                    pa.array([o for o in ORDERS for _ in FILTERS], pa.string()),
                    pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)).astype(np.int32)),
                    *[pa.array(of[m]) for m in ("kept", "removed", "redundant")],
                    pa.array(f[STEPS * len(MEASURES):][at]),
                    *[pa.array(of[m]) for m in ("good_lost", "toxic_lost")],
                    pa.array(shapley.astype(np.int64)[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _OUT.split(", ")])


def part_sums(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, total): the big integer of every part as bytes."""
    counted = failure_masks(docs).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("rows"))
    said = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null")
    said = said.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                                      F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = counted.join(said, "doc_id", "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"), "rows")
    sums = joined.mapInArrow(_sum_masks, "part string, total binary")
    return sums.groupBy("part").applyInArrow(_merge, "part string, total binary")


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley: 600 rows per part."""
    return part_sums(docs, labels).mapInArrow(_unpack, _OUT)
