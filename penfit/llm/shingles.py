"""Word shingles as 64-bit hashes, vectorised over one Arrow string buffer.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``; A-Z is lower-cased. All
other code points keep their bytes, so the byte view and the character view
give the same words (the separators are ASCII and never part of a longer UTF-8
sequence).

A word's hash is the sum of its mixed bytes times powers of an odd constant
(mod 2**64) plus its length, finally mixed; a shingle's hash combines its word
hashes the same way. Two different shingles collide with probability about
2**-64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P1 = 0x9E3779B97F4A7C15
_P2 = 0xBF58476D1CE4E5B9
_P3 = 0x94D049BB133111EB
_MASK = (1 << 64) - 1
SHINGLE_WORDS = 5


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift, multiply, shift, multiply, shift)."""
    x = x ^ (x >> _U(30))
    x = x * _U(_P2)
    x = x ^ (x >> _U(27))
    x = x * _U(_P3)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    b[65:91] += _U(32)
    return mix64((b + _U(1)) * _U(_P1))


_BYTE = _byte_values()
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 0xD6E8FEB86659FD93 | 1


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done:done + take] = out[:take] * _U(pow(_STEP, done, 1 << 64))
        done += take
    return out


def shingle_hashes(words: np.ndarray, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all ``size``-word windows; fewer words make one shingle of the
    whole sequence; no words, none. Not made distinct."""
    n = words.size
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    acc = np.full(n - width + 1, _U((width * _P1) & _MASK))
    for k in range(width):
        acc = acc * _U(_STEP) + words[k:n - width + 1 + k]
    return mix64(acc)


_POWERS = _powers(1024)
GROUP_BYTES = 1 << 20


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of neighbouring texts, bounds): the words of text i are
    those from ``bounds[i]`` to ``bounds[i + 1]``. ``offsets`` index ``data``."""
    n = len(offsets) - 1
    none = np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    if data.size == 0:
        return none
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < data.size]
    begins[edge] = inside[edge]  # a word never goes on from one text into the next
    starts = np.flatnonzero(begins)
    if starts.size == 0:
        return none
    places = np.cumsum(inside) - 1  # of a byte among the bytes of words
    first = places[starts]
    kept = _BYTE[data[inside]]
    lengths = np.diff(first, append=kept.size)
    longest = int(lengths.max())
    powers = _POWERS if longest <= _POWERS.size else _powers(longest)
    kept *= powers[np.arange(kept.size) - np.repeat(first, lengths)]
    words = mix64(np.add.reduceat(kept, first) + lengths.astype(np.uint64) * _U(_P3))
    return words, np.searchsorted(starts, offsets)


def _sets_of_group(offsets: np.ndarray, data: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of neighbouring texts; ``offsets`` index ``data``."""
    n = len(offsets) - 1
    words, bounds = word_hashes(offsets, data)
    windows = shingle_hashes(words, size) if words.size >= size else words[:0]
    out = []
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        got = windows[a:b - size + 1] if b - a >= size else shingle_hashes(words[a:b], size)
        got = np.sort(got)
        if got.size > 1:
            got = got[np.concatenate(([True], got[1:] != got[:-1]))]
        out.append(got)
    return out


def groups_of_batch(offsets: np.ndarray, data: np.ndarray, size: int = GROUP_BYTES):
    """(first text, offsets from 0, bytes) of neighbouring texts of about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, np.asarray(offsets[lo:hi + 1], np.int64) - int(offsets[lo]), data[offsets[lo]:offsets[hi]]
        lo = hi


def sets_of_batch(offsets: np.ndarray, data: np.ndarray, valid: np.ndarray | None = None,
                  size: int = SHINGLE_WORDS):
    """Sorted distinct shingle hashes of every text of an Arrow string buffer
    (``offsets`` has one entry more than there are texts), in order. Texts are
    taken in groups of about ``GROUP_BYTES``, which bounds the memory."""
    for lo, own, part in groups_of_batch(offsets, data):
        for k, s in enumerate(_sets_of_group(own, part, size)):
            yield s if valid is None or valid[lo + k] else np.empty(0, np.uint64)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(offsets, bytes, validity) of a pyarrow string array without copies."""
    import pyarrow as pa
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, off, dat = column.buffers()
    if n == 0 or off is None:
        return np.zeros(1, np.int64), np.empty(0, np.uint8), None
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + n + 1]
    data = np.frombuffer(dat, dtype=np.uint8) if dat is not None else np.empty(0, np.uint8)
    valid = None
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
    return offsets, data, valid
