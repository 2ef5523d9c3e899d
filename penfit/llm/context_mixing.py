"""Byte model of texts: online logistic mixing of hashed-context bit predictors.

A text is coded as its words, A-Z lower-cased, each with a space behind it, and an
end sign. Bytes are coded as the bits of their path in the Huffman tree of the
training texts' bytes (every byte has a path). Each bit has three predictors: tables
of how often it was 0 and 1 in training after the same 2, 4 or 6 bytes at
the same node, kept in hashed slots. The predictors' log odds are mixed by weights
that a gate picks (how many of the contexts were seen in training), and the mix is
refined by an adaptive map from its probability to the frequency of ones seen
there so far. Weights and map start the same in every text and learn online
while it is read, in blocks of bytes that grow from ``FIRST_BLOCK`` to
``LAST_BLOCK``: a block is predicted with what the blocks before it taught. So a
text's probability depends on the text and the tables alone, and the
probabilities of all texts add up to at most one.

Jobs: (0) bytes, words and rows of the training texts; (1) one scan gives bit counts
of the training texts, a table of fixed size per task, added up in Spark, and word counts of
all texts by hash range; (2) one scan scores all texts with the broadcast
tables (``TABLE_BITS`` fixes their size, 2 x 2^TABLE_BITS bytes) and sends each
text's rare words to their hash ranges, where they meet the counts; the sums go back to
the texts' blocks. Frequent words (at least a 2^-HOT_BITS-th of all, so at
most 2^HOT_BITS words) are looked up in the scan instead, so no range holds a
large share of the rows.

Words are compared by 64-bit hashes (two different words agree with probability
2^-64). Null, empty and white-space texts have the end token only. A row without
doc_id is not learned from and not held out. Repeated rows each count and get a
row. Very long texts are one array of bits in one task. An empty table gives an
empty result; without training rows N and V are 0. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penfit.llm.common import pick, stage
from penfit.llm.shingles import groups_of_batch, text_buffers, word_hashes

ORDERS = (3, 5)
TABLE_BITS = 21
PART_BITS = 18
HOT_BITS = 18
FOLDS = 10
FIRST_BLOCK, LAST_BLOCK, BLOCK_GROWTH = 16, 2048, 1.5
START_WEIGHT = 0.75
RATE = 0.06
MAP_STEPS, MAP_PRIOR = 24, 24.0
COUNT_PRIOR = 0.4
GROUP = 1 << 17
BLOCK_ROWS, BLOCK_ENTRIES = 4096, 1_500_000
WORDS_HELD = 500_000
LEVEL = 16
RANGE_ENTRIES = 2_000_000
SPACE, END = 0x20, 0x0A
SMOOTH = 0.1

PAD = max(ORDERS)
_PADDING = bytes(PAD)
ODDS_STEPS = 16
GATES = 3  # how many of the contexts were seen in training


# -- stream and bits ------------------------------------------------------------

def stream_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, bounds) of neighbouring texts: ``PAD`` zeros that are not coded, the
    words with a space behind each, END."""
    raw, parts, bounds, at = memoryview(np.ascontiguousarray(data)), [], [0], 0
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        words = bytes(raw[lo:hi]).lower().split()  # A-Z; splits at exactly [\x20\x09-\x0D]
        words.append(b"\n")
        part = b" ".join(words)
        parts += (_PADDING, part)
        at += PAD + len(part)
        bounds.append(at)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(bounds, np.int64)


def pairs_of(symbols: np.ndarray) -> np.ndarray:
    """256 * the byte before + the byte, of every symbol."""
    out = symbols.astype(np.int32)
    out[1:] += symbols[:-1].astype(np.int32) << 8
    return out


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per symbol its path, (inner node, bit) from the root, in the Huffman tree of the
    counts plus one (ties by the order of creation)."""
    heap = [(int(c) + 1, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up, made = {}, 0
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (made, 0), (made, 1)
        heapq.heappush(heap, (a + b, len(counts) + made))
        made += 1
    paths = []
    for s in range(len(counts)):
        path, x = [], s
        while x in up:
            path.append(up[x])
            x = len(counts) + up[x][0]
        paths.append(path[::-1])
    return paths


class Tree:
    """Paths of the 256 bytes after each byte: one Huffman tree per byte before. ``counts``
    is 256 x 256, by the byte before and the byte."""

    def __init__(self, counts: np.ndarray):
        nodes, bits, lengths = [], [], []
        for before in range(256):
            for path in huffman(counts[before]):
                nodes += [before << 8 | inner for inner, _ in path]
                bits += [bit for _, bit in path]
                lengths.append(len(path))
        #: per bit of all paths: a mixed node number, the bit; per pair: where its path starts
        self.keys = (np.array(nodes, np.uint32) + np.uint32(1)) * np.uint32(0x165667B1)
        self.bits = np.array(bits, np.uint8)
        self.lengths = np.array(lengths, np.int32)
        self.first = (np.cumsum(self.lengths) - self.lengths).astype(np.int32)

    def coded(self, pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of bits of every symbol (none for the padding)."""
        out = self.lengths.take(pairs)
        for i in range(PAD):
            out[bounds[:-1] + i] = 0
        return out

    def expand(self, pairs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Place in the paths of every bit of a stream."""
        ends = np.cumsum(lengths, dtype=np.int32)
        out = np.repeat(self.first.take(pairs) - (ends - lengths), lengths)
        out += np.arange(out.size, dtype=np.int32)
        return out


def context_hashes(symbols: np.ndarray) -> list[np.ndarray]:
    """Per order, a mixed 32-bit hash of the bytes before each symbol; the padding before
    a text stands for the bytes it lacks."""
    back = np.zeros((PAD, symbols.size), np.uint32)
    for k in range(1, PAD + 1):
        back[k - 1, k:] = symbols[:-k]
    out, h = [], np.zeros(symbols.size, np.uint32)
    for k in range(1, PAD + 1):
        h += back[k - 1]
        h += np.uint32(1)
        h *= np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k in ORDERS:
            out.append(h * np.uint32(0x85EBCA77))
    return out


def slots(contexts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slots of bits in an order's table, from their contexts and node keys."""
    h = contexts ^ keys
    h *= np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - TABLE_BITS)
    return h


def count_bits(tree: Tree, symbols: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> None:
    """Adds the bits of a stream to ``counts`` (order, 2 * slot + bit)."""
    if symbols.size == 0:
        return
    pairs = pairs_of(symbols)
    lengths = tree.coded(pairs, bounds)
    path = tree.expand(pairs, lengths)
    keys, one = tree.keys.take(path), tree.bits.take(path)
    for k, context in enumerate(context_hashes(symbols)):
        at = slots(np.repeat(context, lengths), keys)
        at <<= np.uint32(1)
        at += one
        np.add.at(counts[k], at.view(np.int32), np.uint32(1))


def log_odds(counts: np.ndarray) -> np.ndarray:
    """(order, slot) log odds of a 1 in steps of 1 / ODDS_STEPS, within one byte; 0 where
    nothing was seen."""
    zeros, ones = counts[:, 0::2].astype(np.float32), counts[:, 1::2].astype(np.float32)
    odds = np.log((ones + np.float32(COUNT_PRIOR)) / (zeros + np.float32(COUNT_PRIOR)))
    return np.clip(np.rint(odds * ODDS_STEPS), -127, 127).astype(np.int8)


# -- online mixing ----------------------------------------------------------------

def block_ends(longest: int) -> list[int]:
    ends, size, at = [], float(FIRST_BLOCK), 0
    while at < longest:
        at += int(size)
        ends.append(at)
        size = min(size * BLOCK_GROWTH, LAST_BLOCK)
    return ends


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places first[i], first[i] + 1, ... of all i, one after the other."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int32) + np.repeat((first - before).astype(np.int32), counts)


def rounds(first: np.ndarray, total: np.ndarray):
    """Per block: (texts that reach it, where their symbols in it begin, how many)."""
    lo, out = 0, []
    for hi in block_ends(int(total.max())):
        live = np.flatnonzero(total > lo)
        out.append((live, first[live] + lo, np.minimum(total[live], hi) - lo))
        lo = hi
    return out


def score_stream(tree: Tree, odds: np.ndarray, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits that each text of a stream costs."""
    n, orders = len(bounds) - 1, len(ORDERS)
    if n == 0:
        return np.zeros(0)
    # symbols in the order of their blocks, so that a block's bits are one slice
    blocks = rounds(bounds[:-1] + PAD, np.diff(bounds) - PAD)
    order = np.concatenate([spans(f, held) for _, f, held in blocks])
    contexts = [c.take(order) for c in context_hashes(symbols)]
    pairs = pairs_of(symbols).take(order)
    lengths = tree.lengths.take(pairs)
    path = tree.expand(pairs, lengths)
    bits_before = np.concatenate(([0], np.cumsum(lengths)))
    keys, y = tree.keys.take(path), tree.bits.take(path).astype(np.float32)
    x = np.empty((orders, path.size), np.float32)
    gate = np.zeros(path.size, np.intp)
    for k, context in enumerate(contexts):
        got = odds[k].take(slots(np.repeat(context, lengths), keys).view(np.int32))
        np.multiply(got, np.float32(1 / ODDS_STEPS), out=x[k])
        gate += got != 0

    cells = n * GATES
    weights = np.full((orders, cells), START_WEIGHT)
    power = np.ones((orders, cells))
    middle = (np.arange(MAP_STEPS) + 0.5) / MAP_STEPS * 16 - 8
    seen = np.full(cells * MAP_STEPS, MAP_PRIOR)
    ones = np.tile(MAP_PRIOR / (1 + np.exp(-middle)), cells)
    cost, lo, at = np.zeros(n), 0, 0
    for live, _, symbols_held in blocks:
        ends = bits_before[at + np.cumsum(symbols_held)]
        at += int(symbols_held.sum())
        held, hi = np.diff(ends, prepend=lo), int(ends[-1])
        xb, yb = x[:, lo:hi], y[lo:hi]
        cell = np.repeat(live * GATES, held)
        cell += gate[lo:hi]
        mixed = np.zeros(hi - lo, np.float32)
        for k in range(orders):
            mixed += weights[k].astype(np.float32).take(cell) * xb[k]
        np.clip(mixed, -12, 12, out=mixed)
        p = 1 / (1 + np.exp(-mixed))
        mixed *= np.float32(MAP_STEPS / 16)
        mixed += np.float32(MAP_STEPS / 2)
        np.clip(mixed, 0, MAP_STEPS - 1, out=mixed)
        step = mixed.astype(np.intp)
        step += cell * MAP_STEPS
        known = (ones / seen).astype(np.float32).take(step)
        # probability of the bit that came
        known += p
        known *= np.float32(0.5)
        got = 1 - np.abs(yb - known)
        starts = np.cumsum(held) - held
        cost[live] -= np.add.reduceat(np.log2(np.maximum(got, np.float32(1e-7))), starts, dtype=np.float64)
        # what the block teaches: weights by its gradient, the map by its frequencies
        miss = yb - p
        for k in range(orders):
            g = np.bincount(cell, miss * xb[k], cells)
            power[k] += g * g
            weights[k] += RATE * g / np.sqrt(power[k])
        seen += np.bincount(step, minlength=seen.size)
        ones += np.bincount(step, yb, ones.size)
        lo = hi
    return cost


# -- counting -------------------------------------------------------------------

def is_training(remainder: int | None) -> bool:
    return remainder is not None and remainder != 0


def _texts(batch: pa.RecordBatch):
    """(first row, training rows, offsets, bytes) of groups of a batch of (fold, text)."""
    folds = batch.column(0).to_numpy(zero_copy_only=False)
    train = ~np.isnan(folds.astype(np.float64)) & (folds != 0)
    offsets, data, _ = text_buffers(batch.column(1))
    for lo, own, part in groups_of_batch(offsets, data, GROUP):
        yield lo, train[lo:lo + len(own) - 1], own, part


def chosen(offsets: np.ndarray, data: np.ndarray, mask: np.ndarray):
    """The texts of a group that ``mask`` picks."""
    sizes = np.diff(offsets)
    if mask.all():
        return offsets, data
    return np.concatenate(([0], np.cumsum(sizes[mask]))), data[np.repeat(mask, sizes)]


_TOTALS = "pairs binary, rows bigint, words bigint, every bigint"


def _total_row(pairs, rows, words, every):
    return pa.RecordBatch.from_arrays(
        [pa.array([zlib.compress(pairs.tobytes(), 1)], pa.binary()), *[pa.array([x], pa.int64()) for x in (rows, words, every)]],
        names=["pairs", "rows", "words", "every"])


def _totals(batches):
    """One row per task: pairs of bytes of the training texts, training rows, words of
    the training texts, words of all texts."""
    held, rows, every = np.zeros(1 << 16, np.int64), 0, 0
    for b in batches:
        for _, train, own, part in _texts(b):
            symbols, bounds = stream_of(own, part)
            held += np.bincount(pairs_of(symbols)[np.repeat(train, np.diff(bounds))], minlength=1 << 16)
            rows += int(train.sum())
            every += int((symbols == SPACE).sum())
    yield _total_row(held, rows, int(held.reshape(256, 256)[:, SPACE].sum()), every)


def _add_totals(batches):
    held, sums = np.zeros(1 << 16, np.int64), np.zeros(3, np.int64)
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            held += np.frombuffer(zlib.decompress(row[0]), np.int64)
            sums += row[1:]
    yield _total_row(held, *sums.tolist())


def ranged(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def summed(keys: np.ndarray, *counts: np.ndarray):
    """Distinct keys, sorted, with the sums of their counts."""
    at, where = np.unique(keys, return_inverse=True)
    return at, *[np.bincount(where, c, at.size).astype(np.int64) for c in counts]


def cut_by_range(keys: np.ndarray, ranges: int):
    """(range, from, to) of sorted keys."""
    to = np.searchsorted(ranged(keys, ranges), np.arange(ranges + 1)) if ranges < keys.size else None
    if to is None:
        used, first = np.unique(ranged(keys, ranges), return_index=True)
        return list(zip(used.tolist(), first.tolist(), [*first[1:].tolist(), keys.size]))
    return [(r, int(to[r]), int(to[r + 1])) for r in np.flatnonzero(np.diff(to)).tolist()]


_COUNTS = "at int, keys binary, learned binary, held binary"


def _count(tree, ranges: int):
    """Rows of word counts (at: the range) and of the bit tables (at: -1 - part)."""
    def rows_of(held):
        keys, learned, every = summed(*[np.concatenate(x) for x in zip(*held)])
        out = [(r, keys[a:b].tobytes(), learned[a:b].tobytes(), every[a:b].tobytes())
               for r, a, b in cut_by_range(keys, ranges)]
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()),
                                           *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)]],
                                          names=["at", "keys", "learned", "held"])

    def run(batches):
        t = tree.value
        tables = np.zeros((len(ORDERS), 2 << TABLE_BITS), np.uint32)
        held, entries = [], 0
        for b in batches:
            for _, train, own, part in _texts(b):
                words, bounds = word_hashes(own, part)
                learned = np.repeat(train, np.diff(bounds))
                got = summed(words, learned, np.ones(words.size, np.int64))
                held.append(got)
                entries += got[0].size
                if entries >= WORDS_HELD:
                    got = summed(*[np.concatenate(x) for x in zip(*held)])
                    held, entries = [got], got[0].size
                    if entries >= WORDS_HELD // 2:
                        yield rows_of(held)
                        held, entries = [], 0
                count_bits(t, *stream_of(*chosen(own, part, train)), tables)
        if entries:
            yield rows_of(held)
        flat, step = tables.ravel(), 1 << PART_BITS
        for i in range(0, flat.size, step):
            part = flat[i:i + step]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1 - i // step], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()),
                     pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=["at", "keys", "learned", "held"])
    return run


def _add_counts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a range's or table part's counts, added up batch by batch."""
    at = key[0].as_py()
    if at < 0:
        total = np.zeros(1 << PART_BITS, np.uint64)
        for b in batches:
            for payload in b.column(1).to_pylist():
                total += np.frombuffer(zlib.decompress(payload), np.uint32)
        out = [zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1), None, None]
    else:
        held, entries, grown = [], 0, 0
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                held.append([np.frombuffer(c, t) for c, t in zip(row, (np.uint64, np.int64, np.int64))])
                entries += held[-1][0].size
                if entries > 2 * grown + WORDS_HELD:
                    held = [summed(*[np.concatenate(x) for x in zip(*held)])]
                    entries = grown = held[0][0].size
        out = [x.tobytes() for x in summed(*[np.concatenate(x) for x in zip(*held)])]
    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *[pa.array([x], pa.binary()) for x in out]],
                                     names=["at", "keys", "learned", "held"])


def _vocabulary(least: int):
    """Per range: number of words seen in training, and the frequent words."""
    def run(batches):
        for b in batches:
            for keys, learned, held in zip(*[b.column(c).to_pylist() for c in ("keys", "learned", "held")], strict=True):
                k, n = np.frombuffer(keys, np.uint64), np.frombuffer(learned, np.int64)
                hot = np.frombuffer(held, np.int64) >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int((n > 0).sum())], pa.int64()), pa.array([k[hot].tobytes()], pa.binary()),
                     pa.array([n[hot].tobytes()], pa.binary())], names=["distinct", "keys", "counts"])
    return run


# -- scoring --------------------------------------------------------------------

_ROWS = ("block bigint, place int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, "
         "cost double, n_bytes bigint, at int, places binary, keys binary, times binary")
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(),
          pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _batch(**cols):
    n = max(len(v) for v in cols.values())
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES)], names=_NAMES)


def _score(model, ranges: int):
    """Rows of documents (place in their block; sums over frequent words) and rows of
    the blocks' rare words by range."""
    def rare_rows(block, rare):
        place, keys, times = [np.concatenate(x) for x in zip(*rare)]
        by = np.argsort(keys, kind="stable")
        place, keys, times = place[by].astype(np.uint16), keys[by], times[by].astype(np.uint32)
        out = [(r, place[a:b].tobytes(), keys[a:b].tobytes(), times[a:b].tobytes())
               for r, a, b in cut_by_range(keys, ranges)]
        return _batch(block=[block] * len(out), at=[o[0] for o in out], places=[o[1] for o in out],
                      keys=[o[2] for o in out], times=[o[3] for o in out])

    def run(batches):
        tree, odds, hot, hot_counts, end_count = model.value
        context = TaskContext.get()
        block, used, rare, entries = (context.partitionId() if context else 0) << 32, 0, [], 0
        for b in batches:
            ids = b.column(2).to_pylist()
            held_out = [f == 0 for f in b.column(0).to_pylist()]
            for lo, _, own, part in _texts(b.select([0, 1])):
                words, bounds = word_hashes(own, part)
                n = len(own) - 1
                cost_all = score_stream(tree, odds, *(stream := stream_of(own, part)))
                sizes = np.diff(stream[1]) - PAD
                for first in range(0, n, BLOCK_ROWS):  # a group of many tiny texts is cut
                    last = min(n, first + BLOCK_ROWS)
                    if used + last - first > BLOCK_ROWS or entries > BLOCK_ENTRIES:
                        if rare:
                            yield rare_rows(block, rare)
                        block, used, rare, entries = block + 1, 0, [], 0
                    w = words[bounds[first]:bounds[last]]
                    text = np.repeat(np.arange(last - first), np.diff(bounds[first:last + 1]))
                    # distinct (text, word) pairs
                    by = np.lexsort((w, text))
                    tw, ww = text[by], w[by]
                    new = np.flatnonzero(np.concatenate(([True], (tw[1:] != tw[:-1]) | (ww[1:] != ww[:-1])))
                                         if w.size else np.empty(0, bool))
                    times = np.diff(new, append=w.size)
                    tw, ww = tw[new], ww[new]
                    at = np.minimum(np.searchsorted(hot, ww), max(hot.size - 1, 0))
                    is_hot = hot[at] == ww if hot.size else np.zeros(ww.size, bool)
                    c = hot_counts[at[is_hot]] if hot.size else np.empty(0, np.int64)
                    m = last - first
                    logs = np.bincount(tw[is_hot], times[is_hot] * np.log10(c + SMOOTH), m) + np.log10(end_count + SMOOTH)
                    known = np.bincount(tw[is_hot], times[is_hot] * (c > 0), m).astype(np.int64) + (end_count > 0)
                    if not is_hot.all():
                        rare.append((tw[~is_hot] + used, ww[~is_hot], times[~is_hot]))
                        entries += rare[-1][0].size
                    yield _batch(block=[block] * m, place=list(range(used, used + m)), doc_id=ids[lo + first:lo + last],
                                 held_out=held_out[lo + first:lo + last], n_tokens=np.diff(bounds[first:last + 1]) + 1,
                                 n_known=known, logs=logs, cost=cost_all[first:last], n_bytes=sizes[first:last])
                    used += m
        if rare:
            yield rare_rows(block, rare)
    return run


def _look_up(key, asked, counts):
    """The rare words of one range meet their counts: per block the sums of its texts."""
    known = counts.column("keys").to_pylist()
    k = np.frombuffer(known[0], np.uint64) if known else np.empty(0, np.uint64)
    n = np.frombuffer(counts.column("learned").to_pylist()[0], np.int64) if known else np.empty(0, np.int64)
    out = []
    for block, places, keys, times in zip(*[asked.column(c).to_pylist() for c in ("block", "places", "keys", "times")],
                                          strict=True):
        c = n[np.searchsorted(k, np.frombuffer(keys, np.uint64))]  # every word of a text was counted
        t, p = np.frombuffer(times, np.uint32), np.frombuffer(places, np.uint16)
        at, where = np.unique(p, return_inverse=True)
        out.append((block, at.tobytes(), np.bincount(where, t * np.log10(c + SMOOTH)).tobytes(),
                    np.bincount(where, t * (c > 0)).astype(np.uint32).tobytes()))
    return pa.table([pa.array([o[0] for o in out], pa.int64()),
                     *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2, 3)]],
                    names=["block", "places", "logs", "known"])


_OUT = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, "
        "score double, bits_per_byte double")


def _finish(tokens: int, unit: float):
    def run(key, rows, sums):
        place = rows.column("place").to_numpy()
        logs, known = np.zeros(BLOCK_ROWS), np.zeros(BLOCK_ROWS, np.int64)
        for places, l, k in zip(*[sums.column(c).to_pylist() for c in ("places", "logs", "known")], strict=True):  # noqa: E741
            p = np.frombuffer(places, np.uint16)
            logs[p] += np.frombuffer(l, np.float64)
            known[p] += np.frombuffer(k, np.uint32)
        n, cost = rows.column("n_tokens").to_numpy(), rows.column("cost").to_numpy()
        return pa.table(
            [rows.column("doc_id"), rows.column("held_out"), rows.column("n_tokens"),
             pa.array(rows.column("n_known").to_numpy() + known[place]), pa.array([tokens] * len(place), pa.int64()),
             pa.array(rows.column("logs").to_numpy() + logs[place] - n * unit), pa.array(-cost * np.log10(2)),
             pa.array(cost / rows.column("n_bytes").to_numpy())],
            names=[c.split()[0] for c in _OUT.split(", ")])
    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10
    probability of the text) and bits_per_byte (of the coded text, END included),
    one row per input row."""
    spark = docs.sparkSession
    got = pick(docs, doc_id=id_col, text=text_col).selectExpr(
        "cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text")
    rows = got.select(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"),
                      "text", "doc_id")
    per_task = rows.select("fold", "text").mapInArrow(_totals, _TOTALS)
    held, trained, words, every = np.zeros(1 << 16, np.int64), 0, 0, 0
    for r in per_task.repartition(8).mapInArrow(_add_totals, _TOTALS).collect():  # 8 rows
        held += np.frombuffer(zlib.decompress(r["pairs"]), np.int64)
        trained, words, every = trained + r["rows"], words + r["words"], every + r["every"]
    held = held.reshape(256, 256)
    tokens = words + trained
    ranges = max(16, every // RANGE_ENTRIES)
    tree = spark.sparkContext.broadcast(Tree(held))
    counted = stage(rows.select("fold", "text").mapInArrow(_count(tree, ranges), _COUNTS), "mixing-partials")
    # two levels: no task reads all tasks' rows of a table part
    level = F.pmod(F.spark_partition_id(), F.lit(LEVEL))
    counted = counted.groupBy("at", level.alias("level")).applyInArrow(_add_counts, _COUNTS)
    counts = stage(counted.groupBy("at").applyInArrow(_add_counts, _COUNTS), "mixing-counts")

    tables = np.zeros(len(ORDERS) * (2 << TABLE_BITS), np.uint32)
    for r in counts.where("at < 0").collect():  # a fixed number of parts
        part = np.frombuffer(zlib.decompress(r["keys"]), np.uint32)
        tables[(-1 - r["at"]) << PART_BITS:][:part.size] = part
    odds = log_odds(tables.reshape(len(ORDERS), -1))
    by_range = counts.where("at >= 0")
    # at most 2^HOT_BITS words are that frequent
    seen = by_range.mapInArrow(_vocabulary(max(1, every >> HOT_BITS)), "distinct bigint, keys binary, counts binary")
    seen = stage(seen, "mixing-vocabulary")
    distinct = (seen.agg(F.sum("distinct")).first()[0] or 0) + (trained > 0)
    hot = seen.where("length(keys) > 0").select("keys", "counts").toArrow()
    keys = np.frombuffer(b"".join(hot.column(0).to_pylist()), np.uint64)
    times = np.frombuffer(b"".join(hot.column(1).to_pylist()), np.int64)
    by = np.argsort(keys)
    model = spark.sparkContext.broadcast((tree.value, odds, keys[by], times[by], trained))

    scored = stage(rows.mapInArrow(_score(model, ranges), _ROWS), "mixing-scores")
    asked = scored.where("at is not null").select("at", "block", "places", "keys", "times")
    sums = asked.groupBy("at").cogroup(by_range.select("at", "keys", "learned").groupBy("at")).applyInArrow(
        _look_up, "block bigint, places binary, logs binary, known binary")
    documents = scored.where("at is null").select("block", "place", "doc_id", "held_out", "n_tokens", "n_known", "logs",
                                                  "cost", "n_bytes")
    unit = float(np.log10(tokens + SMOOTH * (distinct + 1)))
    return documents.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(_finish(tokens, unit), _OUT)
