"""Mixing sources to target weights with fixed-length blocks.

* Sizes are words (runs of ``[^\\x20\\x09-\\x0D]``); a null text has none.
* Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating,
  and share the sum of all sizes; a target stops at ``max_repeat`` times its
  source's size and the excess is shared again by weight until none is above.
* The words of a source, its documents in the order (doc_id, text hash), form
  one stream that is cut into blocks of ``block_words`` words; the last block
  of a source may be shorter.
* A source's output stream has one slot per block it takes: whole epochs over
  all blocks and a last, partial one. Slot k of an epoch maps to a block by a
  keyed Feistel permutation of the source's full blocks (other keys in each
  epoch); the short block comes last. The last slot is cut so that the source
  gives ``round(target)`` words.
* Output shards hold ``shard_slots`` slots each. How many slots each source
  has in a shard is a multinomial draw given the totals (multivariate
  hypergeometric): a binary tree over the shards splits the totals with one
  seeded draw per node, so any shard's counts, and where in each source's
  stream they start, follow from the shard number alone. Above
  ``DRAW_LIMIT`` slots a node splits in proportion (the noise is below 1e-4).
* Slots and blocks are joined on (source, block). Keys are blocks, never
  sources, so a source with a third of all rows is spread evenly.

The table of sources (one row per source) is the only thing the driver holds.
Documents without words take part with taken 0; rows with the same doc_id are
separate documents. An empty table gives an empty result; if no document has
words, every target is 0.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penfit.llm.common import (cut_points, pick, pick_documents, prefix_of_buckets, range_bucket,
                               stage)
from penfit.llm.shingles import _IS_SPACE, mix64, text_buffers

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
MAX_REPEAT = 3
SEED = 77
DRAW_LIMIT = 500_000_000
BROADCAST_SOURCES = 65_536
ROUNDS = 6
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- words ------------------------------------------------------------------

def word_counts(offsets, data, valid) -> np.ndarray:
    n = len(offsets) - 1
    if n == 0:
        return np.empty(0, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = ~_IS_SPACE[data[lo:hi]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    starts = np.asarray(offsets[:-1], dtype=np.int64) - lo
    real = starts < inside.size
    begins[starts[real]] = inside[starts[real]]  # a text's first byte starts a word
    total = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
    out = total[np.asarray(offsets[1:], dtype=np.int64) - lo] - total[starts]
    if valid is not None:
        out[~valid] = 0
    return out


def _count_words(batches):
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2),
             pa.array(word_counts(*text_buffers(b.column(3))), pa.int64())],
            names=["doc_id", "source", "fp", "size"])


def measured(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp"), "text")
    return rows.mapInArrow(_count_words, "doc_id bigint, source string, fp bigint, size bigint")


# -- targets ----------------------------------------------------------------

def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_no, weight, source_size, target): one row per source."""
    held = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    rank = (F.row_number().over(order) - 1).cast("int")
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("source_no", F.lit(len(weights))) + 1)
    table = held.withColumn("source_no", rank).withColumn("weight", weigh)
    table = stage(table, "mix-sources")
    ratio = F.lit(float(max_repeat)) * F.col("source_size") / F.col("weight")
    level = None
    while True:  # ends: every round caps at least one more source
        free = F.lit(True) if level is None else ratio >= F.lit(level)
        r = table.agg(F.sum("source_size").alias("t"), F.sum(F.when(free, F.col("weight"))).alias("w"),
                      F.sum(F.when(~free, max_repeat * F.col("source_size"))).alias("c")).first()
        if not r["t"] or not r["w"]:
            break
        new = (r["t"] - (r["c"] or 0)) / r["w"]
        if level is not None and new <= level:
            break
        level = new
    cap = (F.lit(max_repeat) * F.col("source_size")).cast("double")
    target = F.lit(0.0) if level is None else F.least(cap, F.lit(level) * F.col("weight"))
    return table.withColumn("target", target)


# -- permutation ------------------------------------------------------------

def _hash(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix64(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key) >> np.uint64(1)


def permute(places: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Keyed Feistel permutation of [0, n) per element, with cycle walking on
    the grid ceil(sqrt n) x ceil(n / that); ends for every element."""
    n = n.astype(np.int64)
    a = np.ceil(np.sqrt(n.astype(np.float64))).astype(np.int64)
    a += a * a < n
    a = np.maximum(a, 1)
    b = np.maximum(-(-n // a), 1)
    out = places.astype(np.int64).copy()
    todo = np.flatnonzero(n > 1)
    while todo.size:
        x, aa, bb, kk = out[todo], a[todo], b[todo], key[todo].astype(np.uint64)
        left, right = x // bb, x % bb
        for i in range(ROUNDS):
            k = mix64(kk + np.uint64(i + 1))
            if i % 2 == 0:
                left = (left + (_hash(right, k) % aa.astype(np.uint64)).astype(np.int64)) % aa
            else:
                right = (right + (_hash(left, k) % bb.astype(np.uint64)).astype(np.int64)) % bb
        out[todo] = left * bb + right
        todo = todo[out[todo] >= n[todo]]
    return out


# -- shards -----------------------------------------------------------------

def _split(rng, counts: np.ndarray, take: int) -> np.ndarray:
    total = int(counts.sum())
    if total <= DRAW_LIMIT:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    share = counts * (take / total)
    got = np.minimum(np.floor(share).astype(np.int64), counts)
    short = take - int(got.sum())
    order = np.argsort(got - share, kind="stable")
    while short > 0:  # the largest remainders get one more
        for i in order:
            if short and got[i] < counts[i]:
                got[i] += 1
                short -= 1
    return got


def shard_counts(shard: int, shards: int, shard_slots: int, counts: np.ndarray, seed: int):
    """(first slot, number of slots) of every source in one shard."""
    lo, hi = 0, shards
    total = int(counts.sum())
    have, first = counts.astype(np.int64), np.zeros(len(counts), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        held = min(hi * shard_slots, total) - lo * shard_slots
        left = min((mid - lo) * shard_slots, held)
        got = _split(np.random.default_rng([seed, lo, hi]), have, left)
        if shard < mid:
            hi, have = mid, got
        else:
            lo, have, first = mid, have - got, first + got
    return first, have


def _slots_of_shards(sources: dict, shards: int, shard_slots: int, seed: int, block_words: int):
    """Per shard: its slots with (source_no, epoch, block, take, slot)."""
    counts = np.asarray(sources["slots"], np.int64)
    numbers = np.asarray(sources["source_no"], np.int64)
    sizes = np.asarray(sources["source_size"], np.int64)
    takes = np.asarray(sources["takes"], np.int64)
    blocks = -(-sizes // block_words)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                first, have = shard_counts(shard, shards, shard_slots, counts, seed)
                s = np.repeat(np.arange(len(counts)), have)
                if s.size == 0:
                    continue
                k = np.arange(s.size) - np.repeat(np.cumsum(have) - have, have) + first[s]
                epoch, at = k // blocks[s], k % blocks[s]
                short = at == blocks[s] - 1
                key = mix64(numbers[s].astype(np.uint64) * np.uint64(1009)
                            + epoch.astype(np.uint64) + np.uint64(seed))
                # the last block of a source is its own image
                block = permute(np.where(short, 0, at), np.where(short, 1, blocks[s] - 1), key)
                block = np.where(short, at, block)
                words = np.minimum(block_words, sizes[s] - block * block_words)
                before = epoch * sizes[s] + at * block_words
                take = np.minimum(words, takes[s] - before)
                place = np.argsort(mix64(key + k.astype(np.uint64) * np.uint64(31)), kind="stable")
                slot = np.empty(s.size, np.int64)
                slot[place] = np.arange(s.size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(s.size, shard, np.int64)), pa.array(slot),
                     pa.array(numbers[s].astype(np.int32)), pa.array(epoch.astype(np.int32)),
                     pa.array(block), pa.array(take)],
                    names=["shard", "slot", "source_no", "epoch", "block", "take"])
    return run


def mix(docs: DataFrame, weights=WEIGHTS, block_words: int = BLOCK_WORDS,
        shard_slots: int = SHARD_SLOTS, max_repeat: int = MAX_REPEAT, seed: int = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, spans).

    ``documents``: doc_id, fp, source, size, source_size, target, source_no,
    start (words of the source before it). ``spans``: the mix itself, one row
    per piece of a document in a slot: shard, slot, slot_from, epoch,
    source_no, start, doc_id, fp, doc_from, words.
    """
    spark = docs.sparkSession
    rows = stage(measured(pick(docs, doc_id=id_col, text=text_col, source=source_col)), "mix-sizes")
    n = rows.count()
    table = stage(source_targets(rows, weights, max_repeat), "mix-targets")
    held = [r.asDict() for r in table.orderBy("source_no").collect()]  # one row per source

    # place of every document in its source's stream
    cuts = cut_points(rows, "doc_id", parts or max(8, min(4096, n // 20_000)))
    side = F.broadcast(table) if len(held) <= BROADCAST_SOURCES else table
    named = rows.withColumn("_range", range_bucket(F.col("doc_id"), cuts)).join(
        side.withColumnRenamed("source", "_source"),
        F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    totals = named.groupBy("source_no", "_range").agg(F.sum("size").alias("_held"))
    before = prefix_of_buckets(totals, "_range", "_held", "_before", by=["source_no"])
    within = Window.partitionBy("source_no", "_range").orderBy(
        F.col("doc_id").asc_nulls_last(), "fp").rowsBetween(Window.unboundedPreceding, -1)
    documents = (named.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
                 .join(before.select("source_no", "_range", "_before"), ["source_no", "_range"])
                 .withColumn("start", F.col("_before") + F.col("_within"))
                 .select("doc_id", "fp", "source", "size", "source_size", "target", "source_no", "start"))
    documents = stage(documents, "mix-documents")

    sources = {"source_no": [], "source_size": [], "takes": [], "slots": []}
    for r in held:
        takes = min(round(r["target"]), max_repeat * (r["source_size"] or 0))
        if takes <= 0:
            continue
        size = r["source_size"]
        epochs, rest = divmod(takes, size)
        sources["source_no"].append(r["source_no"])
        sources["source_size"].append(size)
        sources["takes"].append(takes)
        sources["slots"].append(epochs * -(-size // block_words) + -(-rest // block_words))
    shards = -(-sum(sources["slots"]) // shard_slots)
    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    slots = spark.range(0, shards, 1, tasks).mapInArrow(
        _slots_of_shards(sources, shards, shard_slots, seed, block_words),
        "shard bigint, slot bigint, source_no int, epoch int, block bigint, take bigint")

    last = F.floor((F.col("start") + F.col("size") - 1) / F.lit(block_words)).cast("bigint")
    pieces = documents.where("size > 0").select(
        "source_no", "start", "doc_id", "fp", "size",
        F.explode(F.sequence(F.floor(F.col("start") / F.lit(block_words)).cast("bigint"), last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.select("source_no", "block", "start", "doc_id", "fp",
                           (begin - F.col("start")).alias("doc_from"),
                           (begin - F.col("block") * block_words).alias("slot_from"),
                           (end - begin).alias("held"))
    # Spark would take the slots for one row per shard and broadcast them
    spans = slots.hint("merge").join(pieces, ["source_no", "block"]).where("slot_from < take").select(
        "shard", "slot", "slot_from", "epoch", "source_no", "start", "doc_id", "fp", "doc_from",
        F.least(F.col("held"), F.col("take") - F.col("slot_from")).alias("words"))
    return documents, spans


def taken_words(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with ``taken``, the words the mix takes of each."""
    got = spans.groupBy("source_no", "start").agg(F.sum("words").alias("_taken"))
    has = documents.where("size > 0").join(got, ["source_no", "start"], "left")
    none = documents.where("size = 0").withColumn("_taken", F.lit(0).cast("bigint"))
    return has.unionByName(none).select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"),
        "source")


# -- texts ------------------------------------------------------------------

def cut_text(text: str, ranges: list[tuple[int, int]]) -> str:
    """The words of ``ranges`` (first word, number of words; in order, not
    overlapping) of a text: neighbouring ranges stay one passage with its white
    space, others are put on a new line. All words give the text itself."""
    joined: list[list[int]] = []
    for first, words in ranges:
        if joined and joined[-1][1] == first:
            joined[-1][1] = first + words
        else:
            joined.append([first, first + words])
    places = [m.span() for m in _WORD.finditer(text)]
    if joined == [[0, len(places)]]:
        return text
    return "\n".join(text[places[a][0]:places[b - 1][1]] for a, b in joined)


def _cut_texts(batches):
    import pyarrow as pa
    for b in batches:
        d = b.to_pydict()
        out = {c: [] for c in ("doc_id", "text", "lang", "source", "n_chars")}
        for i, text in enumerate(d["text"]):
            copies: dict = {}
            for r in d["parts"][i]:
                copies.setdefault(r["epoch"], []).append((r["doc_from"], r["words"]))
            for key in sorted(copies):
                got = cut_text(text, sorted(copies[key]))
                out["text"].append(got)
                out["n_chars"].append(len(got))
                for c in ("doc_id", "lang", "source"):
                    out[c].append(d[c][i])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["doc_id"], pa.int64()), pa.array(out["text"], pa.string()),
             pa.array(out["lang"], pa.string()), pa.array(out["source"], pa.string()),
             pa.array(out["n_chars"], pa.int64())],
            names=["doc_id", "text", "lang", "source", "n_chars"])


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: one row per document and epoch that takes words
    of it, with the text taken in that epoch (the whole text in full epochs). Rows
    with the same id, text and source have one lang, the smallest."""
    docs = pick_documents(docs)
    documents, spans = mix(docs, **settings)
    # without nulls the grouping's partitioning serves the join as well
    keys = {"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0)), "fp": F.col("fp"),
            "no_source": F.col("source").isNull(), "of": F.coalesce("source", F.lit(""))}
    named = [c.alias(k) for k, c in keys.items()]
    texts = (docs.where("text is not null").withColumn("fp", F.xxhash64("text"))
             .groupBy(*named).agg(F.first("text").alias("text"), F.min("lang").alias("lang")))
    # one row per document row (its start in the stream): copies of a row keep their own spans
    parts = spans.groupBy("source_no", "start").agg(
        F.collect_list(F.struct("epoch", "doc_from", "words")).alias("parts"))
    taken = parts.join(documents.where("size > 0"), ["source_no", "start"]).select(*named, "parts")
    rows = taken.join(texts, list(keys)).select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "text", "lang",
        F.when(~F.col("no_source"), F.col("of")).alias("source"), "parts")
    return rows.mapInArrow(_cut_texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
