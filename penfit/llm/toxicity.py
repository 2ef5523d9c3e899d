"""Toxicity by compression distance with two zstandard dictionaries.

Training (labels of rows with crc32(doc_id) mod 4 = 2 are never read): at most
``max_labelled`` labelled rows, taken by a hash of doc_id, are the sample, split
in two halves by another hash.

* Dictionaries are word lists chosen from the sample, given to zstandard as raw
  content; ``zstandard.train_dictionary`` is not used (README has its figures). A
  length difference tells whether a listed word, or 5 bytes of one, is in the
  window; ordinary text is not modelled. The ordinary dictionary is the most common words of ordinary texts. The toxic dictionary has the same
  content and, before it, words of toxic texts chosen by greedy cover: the next
  word is the one in most toxic texts, where a text already covered c times
  counts 2**-c; words must be in ``MIN_TEXTS`` toxic texts and ``min_ratio`` times as frequent there. (So
  a group of near copies can't fill the dictionary with its own words.)
* A text is cut into windows of ``window_words`` lower-cased words. Each window is
  compressed with both dictionaries; its distance is the ordinary length minus
  the toxic length. A fixed passage that both dictionaries hold goes in front of
  each window, so that a block's fixed costs are paid in either case.
* A logistic model on the largest distances of a text calibrates the
  thresholds: the score is a probability of the label. It is fitted on distances
  of each half under dictionaries trained on the other half.

Scoring is one scan of whole texts with dictionaries of a few kB; no
shuffle. Null, empty and white-space texts have no window and get the score of
distance 0. Without labels of both kinds every score is the share of toxic
labels (0 without labels). Only id, text and the training labels are used.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penfit.llm.common import pick

MAX_LABELLED = 10_000
WINDOW_WORDS = 4
BASE_WORDS = 60
TOXIC_WORDS = 400
MIN_RATIO = 60.0
MIN_TEXTS = 4
TOP = 6
CLIP = 14
THRESHOLD = 0.3
ANCHOR = b"~anchor~passage~of~the~window~"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode())


def train_dictionaries(texts: list[str], toxic: list[int], base_words: int = BASE_WORDS,
                       toxic_words: int = TOXIC_WORDS, min_ratio: float = MIN_RATIO) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents."""
    held = {0: Counter(), 1: Counter()}
    count = {0: 0, 1: 0}
    sets = []
    for text, y in zip(texts, toxic, strict=True):
        s = set(words_of(text))
        held[y].update(s)
        count[y] += 1
        if y:
            sets.append(s)
    base = sorted(held[0].items(), key=lambda x: (-x[1], x[0]))[:base_words]
    ratio = lambda w, c: (c / count[1]) / ((held[0][w] + 0.5) / (count[0] + 1))
    words = {w for w, c in held[1].items() if c >= MIN_TEXTS and ratio(w, c) >= min_ratio}
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for w in s & words:
            where[w].append(i)
    weight = np.ones(len(sets))
    heap = [(-float(len(v)), w) for w, v in where.items()]
    heapq.heapify(heap)
    chosen: list[bytes] = []
    while heap and len(chosen) < toxic_words:
        _, w = heapq.heappop(heap)
        gain = float(weight[where[w]].sum())
        if heap and gain < -heap[0][0] - 1e-9:
            heapq.heappush(heap, (-gain, w))
            continue
        if gain < 1.0:
            break
        chosen.append(w)
        weight[where[w]] *= 0.5
    ordinary = b" " + b" ".join(w for w, _ in reversed(base)) + b" " + ANCHOR
    return ordinary, b" " + b" ".join(reversed(chosen)) + ordinary


class Compressors:
    """Window lengths under both dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes, window_words: int):
        import zstandard as zs
        self.window_words = window_words
        made = []
        for content in (ordinary, toxic):
            log = max(13, math.ceil(math.log2(len(content) + 8192)))
            p = zs.ZstdCompressionParameters(
                window_log=log, hash_log=log - 2, chain_log=log - 2, search_log=6, min_match=5,
                strategy=zs.STRATEGY_GREEDY, write_content_size=False, write_checksum=False,
                write_dict_id=False)
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            made.append(zs.ZstdCompressor(dict_data=d, compression_params=p))
        self.ordinary, self.toxic = made

    def distances(self, text: str | None) -> list[int]:
        words, n = words_of(text), self.window_words
        a, b = self.ordinary.compress, self.toxic.compress
        out = []
        for i in range(0, len(words), n):
            window = ANCHOR + b" " + b" ".join(words[i:i + n]) + b" "
            out.append(len(a(window)) - len(b(window)))
        return out


def features(distances: list[int]) -> list[float]:
    """The ``TOP`` largest distances of a text, clipped to [0, CLIP]."""
    top = heapq.nlargest(TOP, distances)
    top = [min(max(d, 0), CLIP) / CLIP for d in top]
    return top + [0.0] * (TOP - len(top))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic model by Newton steps."""
    x = np.c_[x, x ** 2, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penal = np.full(x.shape[1], ridge)
    penal[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penal),
                               x.T @ (p - y) + penal * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_of(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = np.c_[x, x ** 2, np.ones(len(x))]
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def fit(texts: list[str], toxic: list[int], halves: list[int], window_words: int = WINDOW_WORDS) -> dict:
    """Dictionaries from all texts; calibration on distances of each half under
    dictionaries of the other half."""
    y = np.asarray(toxic, np.int64)
    half = np.asarray(halves, np.int64)
    first, second = np.flatnonzero(half == 0), np.flatnonzero(half == 1)
    if len(set(y[first])) < 2 or len(set(y[second])) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.0}
    x, target = [], []
    for train_on, test_on in ((first, second), (second, first)):
        c = Compressors(*train_dictionaries([texts[i] for i in train_on], [int(y[i]) for i in train_on]),
                        window_words)
        x += [features(c.distances(texts[i])) for i in test_on]
        target += [float(y[i]) for i in test_on]
    ordinary, tox = train_dictionaries(texts, y.tolist())
    return {"ordinary": ordinary, "toxic": tox, "window_words": window_words,
            "weights": fit_logistic(np.array(x), np.array(target)).tolist()}


@functools.lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes, window_words: int) -> Compressors:
    return Compressors(ordinary, toxic, window_words)


def score_texts(model: dict, texts: list) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    if not texts:
        return np.empty(0)
    c = _compressors(model["ordinary"], model["toxic"], model["window_words"])
    return score_of(np.asarray(model["weights"]), np.array([features(c.distances(t)) for t in texts]))


def _score(model: dict):
    def run(batches):
        import pyarrow as pa
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays(
                    [*[s.column(i) for i in range(s.num_columns - 1)],
                     pa.array(score_texts(model, s.column(s.num_columns - 1).to_pylist()), pa.float64())],
                    names=[*s.schema.names[:-1], "score"])
    return run


def is_held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict:
    """Model from at most ``max_labelled`` labelled rows outside the held-out
    quarter; labels or ids that are null are skipped."""
    labels = (pick(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null")
              .where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    chosen = labels.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(max_labelled)
    texts = pick(docs, doc_id="doc_id", text="text").where("text is not null")
    # at most max_labelled ids are broadcast
    rows = texts.join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", "toxic", F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(2)).alias("half")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    got = rows.to_pydict()
    return fit(got["text"], [int(t > 0) for t in got["toxic"]], got["half"])


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED,
                    threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row."""
    model = train(docs, labels, max_labelled)
    rows = pick(docs, doc_id="doc_id", text="text")
    scored = rows.mapInArrow(_score(model), "doc_id bigint, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with their five columns."""
    from penfit.llm.common import pick_documents
    docs = pick_documents(docs)
    model = train(docs, labels)
    kinds = "doc_id bigint, lang string, source string, n_chars bigint, text string, score double"

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                s = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays(
                    [*s.columns, pa.array(score_texts(model, s.column(4).to_pylist()), pa.float64())],
                    names=[*s.schema.names, "score"])

    scored = docs.select("doc_id", "lang", "source", "n_chars", "text").mapInArrow(run, kinds)
    return scored.where(F.col("score") < threshold).select("doc_id", "text", "lang", "source", "n_chars")
