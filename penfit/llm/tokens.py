"""Token ids with the tokenizers library, at the cost of distinct words.

The library's encoding of a text is the concatenation of its encodings of the
text's *units* if no pre-token, normalisation or special token can reach over
a cut. Cuts are made before a run of spaces and newlines that follows a
character that is no white space: pre-tokenizers of the byte-level kind and
the split kind of ``word_bpe`` never put a white-space character behind
another one into the same pre-token, white space is a starter for NFC, and the
special strings hold none. A unit's ids are then looked up in a bounded cache
and computed by the library only when missing. For other tokenizer layouts
every text goes through the library whole.

:meth:`Encoder.encode_column` does this for an Arrow column at once: units are
cut on its bytes, a chunk's distinct units are looked up once, and the missing
ones go through the library's model in one call. It also cuts between a letter
and ASCII punctuation (both kinds end a pre-token there), but not in a text that
may hold a special string.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
import sys
from array import array

import numpy as np
import regex

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Entries of each of the two generations of ``encode``'s cache (about 200 bytes an entry).
CACHE_UNITS = 400_000
#: Entries of ``encode_column``'s cache (about 40 bytes an entry).
COLUMN_UNITS = 600_000
CACHE_CHARS = 48
#: Text bytes whose distinct units are looked up at once; a longer text goes alone,
#: one over LONG_TEXT unit by unit (the chunk's ids must fit 32-bit offsets).
CHUNK_BYTES = 4 << 20
LONG_TEXT = 1 << 27
#: Missing units that go through the library in one call.
CALL_UNITS = 4096

assert array("I").itemsize == 4 and sys.byteorder == "little"

_PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_RUN = re.compile(r"[^ \n]+")
_ODD_SPACE = re.compile(r"[^\S \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: The pre-token patterns of the two tokenizer files, narrowed to ASCII.
_ASCII_BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+",
                         re.ASCII)
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_LATIN_BYTE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Letters, digits and white space below this are the same in all Unicode versions in use.
_STABLE = "\u0180"
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN_WORD = regex.compile(_WORD_PATTERN)
#: Joins missing units; they hold none, and it is a pre-token of its own between them.
_SEP = "\t"
_ASCII_WORDS = re.compile(_ASCII_WORD.pattern + "|" + _SEP, re.ASCII)
_LATIN_WORDS = regex.compile(_WORD_PATTERN + "|" + _SEP)


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_map() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others
    for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def words(text: str) -> list[str]:
    """Units for tokenizers that drop white space: runs of anything else."""
    return _RUN.findall(text)


def units(text: str) -> list[str]:
    if _ODD_SPACE.search(text) is None:
        return _PLAIN.findall(text)
    return _CUT.split(text)


def _marks(table: bytearray, values, mark: int = 1) -> bytearray:
    for v in values:
        table[v] = mark
    return table


_WS = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                        0x202F, 0x205F, 0x3000)]  # white space to Python, hence also to the library
_IS_WS = np.frombuffer(_marks(bytearray(256), [ord(c) for c in _WS if c < "\x80"]), bool)
_WIDE_WS = {n: np.array([int.from_bytes(c.encode()) for c in _WS if len(c.encode()) == n]) for n in (2, 3)}
_IS_LETTER = np.frombuffer(_marks(bytearray(256), [*range(65, 91), *range(97, 123)]), bool)
_IS_PUNCT = np.frombuffer(_marks(bytearray(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), bool)
#: 0: ASCII that joined units may hold, 1: a part of U+00C0 to U+017F, 2: anything else
_JOINABLE = np.frombuffer(_marks(_marks(bytearray([2]) * 256, range(33, 127), 0), [*range(0x80, 0xC0), 0xC3, 0xC4, 0xC5], 1),
                          np.uint8)


def unit_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places in UTF-8 ``data`` where units start, of texts at ``texts`` (n + 1 offsets)."""
    ws = _IS_WS[data]
    for n, codes in _WIDE_WS.items():  # characters of 2 and 3 bytes
        lead = np.flatnonzero((data == 0xC2) if n == 2 else (data >= 0xE1) & (data <= 0xE3))
        if lead.size:
            code = functools.reduce(lambda a, k: a << 8 | data[lead + k].astype(np.int64), range(n), np.int64(0))
            lead = lead[np.isin(code, codes)]
            for k in range(n):
                ws[lead + k] = True
    cut = (data == 32) | (data == 10)
    cut[1:] &= ~ws[:-1]
    letter = _IS_LETTER[data]
    wide = np.flatnonzero(data == 0xC3) + 1  # U+00C0 to U+00FF: letters but for two signs
    letter[wide[(data[wide] != 0x97) & (data[wide] != 0xB7)]] = True
    punct = _IS_PUNCT[data]
    punct[1:] &= letter[:-1]
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|"
    for k in np.unique(np.searchsorted(texts, special, "right")) - 1:
        punct[texts[k]:texts[k + 1]] = False
    cut |= punct
    cut[texts[:-1][texts[:-1] < texts[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of a tokenizer file, with a bounded cache by unit."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        spec["model"].pop("vocab", None)
        spec["model"].pop("merges", None)
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        inner = pre.get("pretokenizers", [{}])
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        safe = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"])
                   and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
        self.kind = "whole"
        if safe and pre.get("type") == "ByteLevel" and norm is None and not pre["add_prefix_space"] \
                and pre.get("use_regex", True):
            self.kind = "byte"
        elif safe and inner[0].get("pattern", {}).get("Regex") == _WORD_PATTERN \
                and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.kind = "word"
        self.specials = specials
        self.model = self.library.model
        self.table = str.maketrans({chr(b): c for b, c in _byte_map().items()})
        # two generations: a full young one becomes the old one, and what is
        # found there is young again, so common units stay
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # the cache of encode_column: units, their ids, and whether met again
        self._forget()
        # the same model behind a plain split: many pre-tokens in one call
        from tokenizers.pre_tokenizers import CharDelimiterSplit
        self.split = Tokenizer(self.model)
        self.split.pre_tokenizer = CharDelimiterSplit(" ")
        alphabet = _byte_map()
        self.alphabet = "".join(" " if b == 1 else alphabet[b] for b in range(256))  # byte 1 is the split
        sep = self.model.tokenize(alphabet[ord(_SEP)])
        self.sep = sep[0].id if len(sep) == 1 else None

    # -- one unit ---------------------------------------------------------
    def pre_tokens(self, unit: str) -> list[str]:
        """Pre-tokens of a unit in the byte-level alphabet, as the library
        makes them; a special string is one pre-token, marked by NUL."""
        if "<|" in unit and any(s in unit for s in self.specials):
            out, rest = [], [unit]
            pattern = "(" + "|".join(re.escape(s) for s in self.specials) + ")"
            for k, part in enumerate(re.split(pattern, rest[0])):
                if k % 2:
                    out.append("\0" + part)
                elif part:
                    out += self.pre_tokens_plain(part)
            return out
        return self.pre_tokens_plain(unit)

    def pre_tokens_plain(self, unit: str) -> list[str]:
        if self.kind == "byte":
            if unit[0] == " " and unit[1:].isalpha() and unit.isascii():
                return ["\u0120" + unit[1:]]  # the commonest case: a space and letters
            if unit.isascii():
                found = _ASCII_BYTE.findall(unit)
            elif max(unit) < _STABLE:
                found = [p.encode().decode("latin-1") for p in _LATIN_BYTE.findall(unit)]
            else:
                return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(unit)]
            return [p if p.isalnum() and p.isascii() else p.translate(self.table) for p in found]
        if unit.isascii():
            found = _ASCII_WORD.findall(unit.lower())
            return [p if p.isalnum() else p.translate(self.table) for p in found]
        lower = unit.lower()
        if max(lower) < _STABLE and max(unit) < _STABLE and _ODD_SPACE.search(unit) is None:  # NFC already
            found = [p.encode().decode("latin-1") for p in _LATIN_WORD.findall(lower)]
            return [p if p.isalnum() and p.isascii() else p.translate(self.table) for p in found]
        norm = self.library.normalizer.normalize_str(unit)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def piece_ids(self, pre_token: str) -> list[int]:
        if pre_token[0] == "\0":
            return [self.library.token_to_id(pre_token[1:])]
        return [t.id for t in self.model.tokenize(pre_token)]

    def _unit_bytes(self, unit: str) -> bytes:
        got = self.old.get(unit)
        if got is None:
            ids = [i for p in self.pre_tokens(unit) for i in self.piece_ids(p)]
            got = array("I", ids).tobytes()
        if len(unit) <= CACHE_CHARS:
            if len(self.young) >= CACHE_UNITS:
                self.old, self.young = self.young, {}
            self.young[unit] = got
        return got

    # -- many units -------------------------------------------------------
    def _joined_ids(self, group: list[bytes], ascii_only: bool) -> list[bytes]:
        """Ids of units without white space but a first character, and of
        characters below U+0180 only."""
        text = _SEP.join([u.decode() for u in group])
        if self.kind == "byte":
            found = (_ASCII_BYTE if ascii_only else _LATIN_BYTE).findall(text)
        else:
            found = (_ASCII_WORDS if ascii_only else _LATIN_WORDS).findall(text.lower())
        line = codecs.charmap_decode("\1".join(found).encode(), "strict", self.alphabet)[0]
        ids = np.array(self.split.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(ids == self.sep) * 4).tolist()
        assert len(ends) == len(group) - 1
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)]

    def _missing_ids(self, group: list[bytes]) -> list[bytes]:
        sizes = np.array([len(u) for u in group])
        data = np.frombuffer(b"".join(group), np.uint8)
        first = np.cumsum(sizes) - sizes
        marks = _JOINABLE[data]
        spaced = (data[first] == 32) | (data[first] == 10)
        marks[first[spaced & (sizes > 1)]] = 0
        marks[:-1][(data[:-1] == 60) & (data[1:] == 124)] = 2  # "<|"
        marks[:-1][(data[:-1] == 0xC4) & (data[1:] == 0xB0)] = 2  # a capital that has two characters in lower case
        marks = np.maximum.reduceat(marks, first)
        if self.sep is None:
            marks[:] = 2
        out = {}
        for mark in (0, 1):
            some = [group[i] for i in np.flatnonzero(marks == mark)]
            for lo in range(0, len(some), CALL_UNITS):
                part = some[lo:lo + CALL_UNITS]
                out.update(zip(part, self._joined_ids(part, mark == 0), strict=True))
        for i in np.flatnonzero(marks == 2):
            ids = [i for p in self.pre_tokens(group[i].decode()) for i in self.piece_ids(p)]
            out[group[i]] = array("I", ids).tobytes()
        return [out[u] for u in group]

    def _distinct_ids(self, units):
        """(ids of units, places of the given distinct units among them)."""
        import pyarrow as pa
        import pyarrow.compute as pc
        known = pc.index_in(units, value_set=self.keys)
        places = known.fill_null(-1).to_numpy()
        fresh = places < 0
        self.used[places[~fresh]] = True
        if not fresh.any():
            return self.values, places
        held = len(self.keys)
        new = units.filter(pa.array(fresh))
        ends = np.frombuffer(new.buffers()[1], np.int32)[:len(new) + 1].tolist()
        raw = new.buffers()[2].to_pybytes()
        made = pa.array(self._missing_ids([raw[a:b] for a, b in zip(ends, ends[1:])]), pa.binary())
        values = pa.concat_arrays([self.values, made])
        places = np.where(fresh, held - 1 + np.cumsum(fresh), places)
        short = pc.less_equal(pc.binary_length(new), CACHE_CHARS)
        new, made = new.filter(short), made.filter(short)
        if held + len(new) > COLUMN_UNITS:  # only units met again since the last time stay
            again = pa.array(self.used)
            self.keys, self.values = self.keys.filter(again), self.values.filter(again)
            self.used = np.zeros(len(self.keys), bool)
        if len(self.keys) + len(new) > COLUMN_UNITS:
            self._forget()
        if len(new) <= COLUMN_UNITS:
            self.keys, self.values = pa.concat_arrays([self.keys, new]), pa.concat_arrays([self.values, made])
            self.used = np.append(self.used, np.zeros(len(new), bool))
        return values, places

    def _forget(self) -> None:
        import pyarrow as pa
        self.keys, self.values, self.used = pa.array([], pa.binary()), pa.array([], pa.binary()), np.zeros(0, bool)

    def _chunk(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        if self.kind == "word":
            data = np.where(data == 10, np.uint8(32), data)  # white space is dropped: fewer distinct units
        starts = unit_starts(data, texts)
        offsets = np.append(starts, data.size).astype(np.int32)
        cut = pa.BinaryArray.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        cut = cut.dictionary_encode()
        values, places = self._distinct_ids(cut.dictionary)
        made = values.take(pa.array(places[cut.indices.to_numpy()]))
        ends = np.frombuffer(made.buffers()[1], np.int32)[:starts.size + 1] // 4
        ids = np.frombuffer(made.buffers()[2], "<u4")[:ends[-1]]
        return ids, ends[np.searchsorted(starts, texts)]

    def encode_column(self, column):
        """(texts, ids, offsets) for runs of texts of an Arrow string column, in
        order: ids of all texts of the run and where each text's begin (one more
        offset than texts; a null is empty)."""
        if column.null_count:
            column = column.fill_null("")
        sizes = np.zeros(len(column) + 1, np.int64)
        kind = np.int64 if str(column.type).startswith("large") else np.int32
        if len(column):
            sizes = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2] if len(column) else None
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + CHUNK_BYTES, "right")) - 1)
            texts = sizes[lo:hi + 1] - sizes[lo]
            if texts[-1] == 0:
                yield hi - lo, np.zeros(0, "<u4"), texts
            elif self.kind == "whole" or texts[-1] > LONG_TEXT:
                made = [np.frombuffer(self.encode(t), "<u4") for t in column.slice(lo, hi - lo).to_pylist()]
                yield hi - lo, np.concatenate(made), np.cumsum([0, *[m.size for m in made]])
            else:
                ids, offsets = self._chunk(data[sizes[lo]:sizes[hi]], texts)
                yield hi - lo, ids, offsets.astype(np.int64)
            lo = hi
        import pyarrow as pa
        pa.default_memory_pool().release_unused()  # an idle worker would keep the chunks' memory

    # -- whole texts ------------------------------------------------------
    def encode(self, text: str | None) -> bytes:
        """Ids of a text (null: empty) as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        if self.kind == "whole":
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        found, make = self.young.get, self._unit_bytes
        cut = units if self.kind == "byte" else words
        return b"".join([found(u) or make(u) for u in cut(text)])


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process: its cache lives on over tasks."""
    return Encoder(path)
