"""Periodic runs of words by multi-scale minimizers.

A run is a maximal stretch of words with smallest period q and at least
max(24, 3 q) words. Texts are independent, so the operator is one scan without a
shuffle; inside a task, neighbouring texts are handled together as one array of
word numbers, with a number of its own between two texts (no run reaches over it).

* Periods below ``SHORT``: the array is compared with itself at each lag; long
  enough stretches of equality are the candidates.
* Periods in [w, 2 w), for w = SHORT, 2 SHORT, ...: of every w / 2 neighbouring
  (w / 2)-grams the one with the smallest hash is a minimizer. Grams that lie in a
  stretch already found with a period of at most a third of the gram are left out.
  A run of smallest period q >= w has, within any q places, a gram that is not left
  out (else all of it would have that smaller period), and the window that
  starts there lies in the run, as does its image q words on: both have the same
  minimizers. So some pair of equal minimizers is q apart. Equal grams that are not
  left out lie more than a sixth of w apart, so a gram has at most a dozen partners
  less than 2 w away. Each pair at a distance d in [w, 2 w) seeds an extension
  if d equal words precede or follow it (block hashes tell).
* Seeds are extended word by word to maximal stretches with that lag; a stretch that
  also has a smaller period, a divisor of its lag, is dropped.

Texts shorter than 3 w words take no part in scale w, so work is n log^2 n at
most, whatever the text. Null, empty and white-space texts have no words and no
run. Repeated rows each get a row, an empty table gives an empty result, other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from penfit.llm.common import pick
from penfit.llm.shingles import mix64

MIN_WORDS, MIN_PERIODS = 24, 3
#: Periods below it are found by direct lag scans; the first scale. A power of two.
SHORT = 16
GROUP_WORDS = 200_000
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


# -- stretches of one lag -------------------------------------------------------

def lag_stretches(ids: np.ndarray, lag: int, least: int) -> list[tuple[int, int]]:
    """[start, end) of maximal stretches with ``ids[i] == ids[i + lag]`` inside
    and at least ``least`` words."""
    if ids.size < least:
        return []
    breaks = np.flatnonzero(ids[lag:] != ids[:-lag])
    edges = np.concatenate(([-1], breaks, [ids.size - lag]))
    held = np.diff(edges) - 1
    at = np.flatnonzero(held >= max(1, least - lag))
    return [(int(edges[i]) + 1, int(edges[i + 1]) + lag) for i in at]


def extended(ids: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The maximal stretch with period ``lag`` around words ``at`` and ``at + lag``."""
    lo, step = at, 64
    while lo > 0:
        a = max(0, lo - step)
        bad = np.flatnonzero(ids[a:lo] != ids[a + lag:lo + lag])
        if bad.size:
            lo = a + int(bad[-1]) + 1
            break
        lo, step = a, step * 2
    hi, step = at, 64
    while hi < ids.size - lag:
        b = min(ids.size - lag, hi + step)
        bad = np.flatnonzero(ids[hi:b] != ids[hi + lag:b + lag])
        if bad.size:
            hi += int(bad[0])
            break
        hi, step = b, step * 2
    return lo, hi + lag


def prime_factors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] if n > 1 else out


def is_smallest(ids: np.ndarray, start: int, end: int, lag: int) -> bool:
    """Whether no smaller period holds in a stretch of at least two periods
    (a smaller one that did would make a proper divisor a period)."""
    s = ids[start:end]
    return not any(np.array_equal(s[lag // f:], s[:s.size - lag // f]) for f in prime_factors(lag))


# -- minimizers -----------------------------------------------------------------

def prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums of word hashes times powers, inverse powers), mod 2**64."""
    powers = np.full(ids.size + 1, np.uint64(_BASE))
    powers[0] = 1
    inverse = np.full(ids.size + 1, np.uint64(_BASE_INVERSE))
    inverse[0] = 1
    values = mix64(ids.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(powers)[:-1]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))), \
        np.multiply.accumulate(inverse)


def block_hash(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    return (sums[start + size] - sums[start]) * inverse[start]


def sliding(values: np.ndarray, width: int, how) -> np.ndarray:
    """Minimum or maximum of every ``width`` (a power of two) neighbours."""
    out, step = values, 1
    while step < width:
        out = how(out[:-step], out[step:])
        step *= 2
    return out


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest value of some ``width`` neighbours."""
    low = sliding(grams, width, np.minimum)
    # a place is a minimizer if the largest of its windows' minima is its own value
    edge = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate((edge, low, edge)), width, np.maximum)
    return np.flatnonzero((best == grams) & (grams != _NONE))


def seeds(ids: np.ndarray, scale: int, found: list, sums, inverse) -> list[tuple[int, int]]:
    """(lag, place), sorted: equal minimizers ``lag`` apart, in [scale, 2 scale),
    with a square of that lag beside them."""
    k = scale // 2
    if ids.size < k + k:
        return []
    starts = np.arange(ids.size - k + 1)
    grams = mix64(block_hash(sums, inverse, starts, k))
    for start, end, period in found:
        if MIN_PERIODS * period <= k <= end - start:
            grams[start:end - k + 1] = _NONE
    at = minimizers(grams, k)
    at = at[np.argsort(grams[at], kind="stable")]
    same = grams[at]
    out = []
    for t in itertools.count(1):
        if t >= at.size:
            break
        gap = at[t:] - at[:-t]
        near = (same[t:] == same[:-t]) & (gap < 2 * scale)
        if not near.any():
            break
        hit = np.flatnonzero(near & (gap >= scale))
        out.append((gap[hit], at[hit]))
    if not out:
        return []
    lag, place = (np.concatenate(x) for x in zip(*out))

    def square(first):
        ok = (first >= 0) & (first + 2 * lag <= ids.size)
        a, q = np.where(ok, first, 0), np.where(ok, lag, 0)
        return ok & (block_hash(sums, inverse, a, q) == block_hash(sums, inverse, a + q, q))
    keep = square(place) | square(place - lag)
    return sorted(zip(lag[keep].tolist(), place[keep].tolist()))


def find_runs(ids: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of an array of word numbers in which no
    text is longer than ``longest``; sorted."""
    found = []  # also stretches too short for a run: grams inside them are left out
    for lag in range(1, min(SHORT, longest // MIN_PERIODS + 1)):
        for start, end in lag_stretches(ids, lag, max(MIN_PERIODS * lag, SHORT // 2)):
            if is_smallest(ids, start, end, lag):
                found.append((start, end, lag))
    scale = SHORT
    if MIN_PERIODS * scale <= longest:
        sums, inverse = prefix_hashes(ids)
        while MIN_PERIODS * scale <= longest:
            made, reached = [], {}
            for lag, at in seeds(ids, scale, found, sums, inverse):
                if at + lag < reached.get(lag, -1):  # inside the stretch of an earlier seed
                    continue
                start, end = extended(ids, at, lag)
                reached[lag] = end
                if end - start >= MIN_PERIODS * lag and is_smallest(ids, start, end, lag):
                    made.append((start, end, lag))
            found += made
            scale *= 2
    return sorted({r for r in found if r[1] - r[0] >= max(MIN_WORDS, MIN_PERIODS * r[2])})


# -- documents ------------------------------------------------------------------

def looped(words: list, doc_id) -> list:
    """The words the query looks at: of one id in ten they are repeated from some
    word on. A row without id keeps its words."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then
    period. Lists of more than SHORT periods are grouped by their size, so that
    short texts take no part in the scales of long ones."""
    out: list = [[] for _ in texts]
    sized = defaultdict(list)
    for i, words in enumerate(texts):
        if len(words) >= MIN_WORDS:
            sized[len(words).bit_length()].append(i)
    for members in sized.values():
        numbers: dict = defaultdict(itertools.count().__next__)
        parts, starts, at = [], [], 0
        for i in members:
            words = texts[i]
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            parts.append(np.array([-1 - len(starts)], np.int64))  # differs from all others
            starts.append(at)
            at += len(words) + 1
        first = np.array(starts)
        for start, end, period in find_runs(np.concatenate(parts), max(len(texts[i]) for i in members)):
            t = int(np.searchsorted(first, start, "right")) - 1
            out[members[t]].append((start - starts[t], end - start, period))
    return out


def best_run(runs: list):
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def collapsed(words: list, runs: list) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    keep = np.cumsum(cover[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


_SCHEMA = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
           "runs_sha256 string, collapsed_sha256 string")


def _scan(prepare):
    names = [c.split()[0] for c in _SCHEMA.split(", ")]

    def rows_of(ids, texts):
        import pyarrow as pa
        cols: dict = {c: [] for c in names}
        for doc_id, words, runs in zip(ids, texts, runs_of_texts(texts), strict=True):
            best = best_run(runs)
            cols["doc_id"].append(doc_id)
            cols["n_runs"].append(len(runs))
            for j, c in enumerate(("start", "length", "period")):
                cols[c].append(best and best[j])
            cols["exponent_milli"].append(best and 1000 * best[1] // best[2])
            listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
            cols["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
            cols["collapsed_sha256"].append(hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())
        types = [pa.string() if c.endswith("sha256") else pa.int64() for c in names]
        return pa.RecordBatch.from_arrays([pa.array(cols[c], t) for c, t in zip(names, types)], names=names)

    def run(batches):
        for b in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(b.column(0), b.column(1)):
                i, raw = doc_id.as_py(), text.as_buffer()
                words = bytes(raw).split() if raw is not None else []  # splits at exactly [\x20\x09-\x0D]
                words = prepare(words, i)
                ids.append(i)
                texts.append(words)
                held += len(words)
                if held >= GROUP_WORDS:
                    yield rows_of(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows_of(ids, texts)
    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  prepare=lambda words, doc_id: words) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with the
    greatest length / period (null without a run), runs_sha256 and collapsed_sha256,
    one row per input row. ``prepare(words, doc_id)`` may change a text's words first."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        _scan(prepare), _SCHEMA)


def run_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The runs themselves: doc_id, start, length, period, one row per run."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [(t or "").encode().split() for t in b.column(1).to_pylist()]
            got = [(i, *r) for i, runs in zip(ids, runs_of_texts(texts), strict=True) for r in runs]
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(4)],
                                             names=["doc_id", "start", "length", "period"])
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, period bigint")
