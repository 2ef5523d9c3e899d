"""Token counts from counts of distinct pre-tokens.

1. One scan counts every pre-token over all documents. A task holds a bounded
   dictionary (flushed at ``FLUSH_UNITS`` entries), so it sends a row per distinct
   pre-token instead of a row per occurrence; a second aggregate adds them up.
2. The library cuts each distinct pre-token into pieces once; only the number of
   pieces is kept. The table (pre_token, occurrences, pieces) is written to the
   shared folder.
3. Per-document frequencies are joined to it. Pre-tokens with more than
   ``total occurrences / HOT`` occurrences (fewer than ``HOT`` by arithmetic, at
   most ``HOT_CHARS`` characters each: a proven bound) are looked up inside the
   scan, which leaves one partial sum per document; the others are sent as (row,
   pre-token, frequency) and meet the table in a shuffled join. No key of that
   join holds more than a ``1 / HOT`` part of the occurrences.
4. Sums are added per document. Token ids never exist.

A null or empty text has no tokens. Rows are told apart by a row key, so rows
that share a doc_id are counted on their own. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penfit.llm.common import pick, stage
from penfit.llm.tokens import BYTE_BPE, encoder, tokenizer_path, units

FLUSH_UNITS = 300_000
HOT = 1 << 19
HOT_CHARS = 64
LIMIT = 512


def _pre_tokens_of(enc, counts: Counter) -> Counter:
    out: Counter = Counter()
    for unit, n in counts.items():
        for p in enc.pre_tokens(unit):
            out[p] += n
    return out


def _count_pre_tokens(path: str):
    def run(batches):
        import pyarrow as pa
        enc, held = encoder(path), Counter()

        def flushed():
            out = _pre_tokens_of(enc, held)
            held.clear()
            keys = list(out)
            for lo in range(0, len(keys), 100_000):
                part = keys[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([out[k] for k in part], pa.int64())],
                    names=["pre_token", "occurrences"])

        for b in batches:
            for text in b.column(0):
                value = text.as_py()
                if value:
                    held.update(units(value))
                if len(held) >= FLUSH_UNITS:
                    yield from flushed()
        yield from flushed()
    return run


def _count_pieces(path: str):
    def run(batches):
        import pyarrow as pa
        enc = encoder(path)
        for b in batches:
            n = [len(enc.piece_ids(p)) for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             names=["pre_token", "occurrences", "pieces"])
    return run


def pre_token_table(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(pre_token, occurrences, pieces) over all rows of ``texts`` (text)."""
    if encoder(tokenizer).kind == "whole":
        raise ValueError("this tokenizer has no pre-tokens that can be counted on their own")
    seen = texts.select("text").mapInArrow(_count_pre_tokens(tokenizer),
                                           "pre_token string, occurrences bigint")
    distinct = seen.groupBy("pre_token").agg(F.sum("occurrences").alias("occurrences"))
    return stage(distinct.mapInArrow(_count_pieces(tokenizer),
                                     "pre_token string, occurrences bigint, pieces bigint"), "pre-tokens")


def _frequencies(path: str, hot):
    """Rows (row, doc_id, n_bytes, known) per document and (row, pre_token,
    frequency) for what the hot table doesn't hold."""
    def run(batches):
        import pyarrow as pa
        enc, table = encoder(path), _hot_table(hot)
        for b in batches:
            row_ids = b.column(0).to_pylist()
            ids = b.column(1).to_pylist()
            out = {c: [] for c in ("row", "doc_id", "n_bytes", "known", "pre_token", "frequency")}

            def add(row, doc_id=None, n_bytes=None, known=0, pre=None, freq=None, out=out):
                for k, v in zip(out, (row, doc_id, n_bytes, known, pre, freq), strict=True):
                    out[k].append(v)

            for row, doc_id, text in zip(row_ids, ids, b.column(2), strict=True):
                value = text.as_py() or ""
                known, rest = 0, None
                for unit, n in Counter(units(value)).items():
                    pieces = table.get(unit)
                    if pieces is None:
                        pieces, left = 0, False
                        for p in enc.pre_tokens(unit):
                            got = table.get(("p", p))
                            if got is None:
                                rest = Counter() if rest is None else rest
                                rest[p] += n
                                left = True
                            else:
                                pieces += got
                        if not left and len(unit) <= HOT_CHARS:
                            table.remember(unit, pieces)
                    known += pieces * n
                add(row, doc_id, len(value.encode()), known)
                for p, n in (rest or {}).items():
                    add(row, pre=p, freq=n)
                if len(out["row"]) >= 50_000:
                    yield _batch(pa, out)
                    for v in out.values():
                        v.clear()
            if out["row"]:
                yield _batch(pa, out)
    return run


def _batch(pa, out):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)],
                                      names=list(out))


class _Hot(dict):
    """Pieces by pre-token, and by unit for units made of hot pre-tokens only."""

    def __init__(self, pairs):
        super().__init__((("p", p), n) for p, n in pairs)
        self.room = 2 * HOT - len(self)

    def remember(self, unit: str, pieces: int) -> None:
        if self.room > 0:
            self[unit] = pieces
            self.room -= 1


_HOT_TABLES: dict = {}


def _hot_table(hot) -> _Hot:
    if hot.id not in _HOT_TABLES:
        _HOT_TABLES.clear()  # one table per worker process
        import pyarrow as pa
        t = pa.ipc.open_stream(hot.value).read_all()
        _HOT_TABLES[hot.id] = _Hot(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
    return _HOT_TABLES[hot.id]


class _Shared:
    """A broadcast with an id that workers can key their table by."""

    def __init__(self, sc, payload: bytes):
        import uuid
        self.id, self.broadcast = uuid.uuid4().hex, sc.broadcast(payload)

    @property
    def value(self):
        return self.broadcast.value


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT,
                 hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row per input row."""
    import pyarrow as pa
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path(BYTE_BPE)
    got = pick(docs, doc_id=id_col, text=text_col)
    table = pre_token_table(got, tokenizer)
    total = table.agg(F.sum("occurrences")).first()[0] or 0
    is_hot = (F.col("occurrences") > F.lit(total / hot)) & (F.length("pre_token") <= HOT_CHARS)
    top = table.where(is_hot).select("pre_token", "pieces").toArrow()  # fewer than ``hot`` rows
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, top.schema) as w:
        w.write_table(top)
    shared = _Shared(spark.sparkContext, sink.getvalue().to_pybytes())
    rows = got.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = rows.mapInArrow(
        _frequencies(tokenizer, shared),
        "row bigint, doc_id bigint, n_bytes bigint, known bigint, pre_token string, frequency bigint")
    # a document's own row has a key of its own, which meets no pre-token
    keyed = parts.withColumn("pre_token", F.coalesce(
        "pre_token", F.concat(F.lit("\u0001"), F.col("row").cast("string"))))
    cold = table.where(~is_hot).select("pre_token", "pieces")
    sums = keyed.join(cold, "pre_token", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.col("known") + F.coalesce(F.col("frequency") * F.col("pieces"), F.lit(0))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
