import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from fixtures_llm import documents, no_documents, odd_documents  # noqa: F401

from penfit.llm import context_mixing as cm
from penfit.llm.shingles import text_buffers


def tokens_of(t):
    return brute.words((t or "").translate(brute._LOWER)) + [None]


def plain_stream(t):
    return "".join(w + " " for w in tokens_of(t)[:-1]).encode() + b"\n"


def buffers(texts):
    import pyarrow as pa
    return text_buffers(pa.array(texts, pa.string()))[:2]


def test_streams():
    texts = ["", "a", " A b\t", "\n", "x" * 50 + " é", "Q", " ", "end\x0b\x0cX"]
    symbols, bounds = cm.stream_of(*buffers(texts))
    for i, t in enumerate(texts):
        assert symbols[bounds[i]:bounds[i + 1]].tobytes() == bytes(cm.PAD) + plain_stream(t)


def plain_cost(tree, odds, t, block_of):
    """Bits of one text, bit by bit, in double precision."""
    data = list(plain_stream(t))
    weights, power = {}, {}
    seen, ones = {}, {}
    cost, pending = 0.0, []
    start = [1 / (1 + math.exp(-((i + 0.5) / cm.MAP_STEPS * 16 - 8))) for i in range(cm.MAP_STEPS)]
    block = 0

    def learn():
        g = {}
        for gate, x, miss, step, y in pending:
            v = g.setdefault(gate, [0.0] * len(x))
            for k, xk in enumerate(x):
                v[k] += miss * xk
            seen[gate, step] = seen.get((gate, step), cm.MAP_PRIOR) + 1
            ones[gate, step] = ones.get((gate, step), start[step] * cm.MAP_PRIOR) + y
        for gate, v in g.items():
            pw, w = power.setdefault(gate, [1.0] * len(v)), weights.setdefault(gate, [cm.START_WEIGHT] * len(v))
            for k, gk in enumerate(v):
                pw[k] += gk * gk
                w[k] += cm.RATE * gk / math.sqrt(pw[k])
        pending.clear()

    for i, s in enumerate(data):
        if i == block_of[block]:
            learn()
            block += 1
        pair = (data[i - 1] if i else 0) << 8 | s
        path = slice(int(tree.first[pair]), int(tree.first[pair] + tree.lengths[pair]))
        one = np.array([0] * cm.PAD + data[:i + 1], np.uint8)
        contexts = [c[-1:] for c in cm.context_hashes(one)]
        for key, y in zip(tree.keys[path], tree.bits[path].tolist()):
            x = [float(odds[k][cm.slots(c, np.array([key]))[0]]) / cm.ODDS_STEPS for k, c in enumerate(contexts)]
            gate = sum(v != 0 for v in x)
            w = weights.get(gate, [cm.START_WEIGHT] * len(x))
            mixed = max(-12, min(12, sum(a * b for a, b in zip(x, w))))
            p = 1 / (1 + math.exp(-mixed))
            step = int(max(0, min(cm.MAP_STEPS - 1, mixed * cm.MAP_STEPS / 16 + cm.MAP_STEPS / 2)))
            known = ones.get((gate, step), start[step] * cm.MAP_PRIOR) / seen.get((gate, step), cm.MAP_PRIOR)
            final = (p + known) / 2
            cost -= math.log2(max(final if y else 1 - final, 1e-7))
            pending.append((gate, x, y - p, step, y))
    return cost


def test_scores_bit_by_bit():
    rng = np.random.default_rng(3)
    learned = [" ".join(rng.choice(["the", "cat", "sat", "on", "mats", "é"], 60)) for _ in range(20)]
    symbols, bounds = cm.stream_of(*buffers(learned))
    tree = cm.Tree(np.bincount(cm.pairs_of(symbols), minlength=1 << 16).reshape(256, 256))
    counts = np.zeros((len(cm.ORDERS), 2 << cm.TABLE_BITS), np.uint32)
    cm.count_bits(tree, symbols, bounds, counts)
    each = [b"\0" + plain_stream(t) for t in learned]
    assert counts.sum() == len(cm.ORDERS) * sum(int(tree.lengths[a << 8 | b]) for t in each for a, b in zip(t, t[1:]))
    odds = cm.log_odds(counts)
    texts = ["the cat sat", "", "Mats é zzz 日本 on " * 5, "the cat " * 40]
    got = cm.score_stream(tree, odds, *cm.stream_of(*buffers(texts)))
    for t, c in zip(texts, got):
        assert c == pytest.approx(plain_cost(tree, odds, t, cm.block_ends(100_000)), rel=1e-3)
    # what a text costs depends on the text and the tables alone
    alone = [cm.score_stream(tree, odds, *cm.stream_of(*buffers([t])))[0] for t in texts]
    assert np.allclose(alone, got, rtol=1e-5)


def test_probabilities_of_next_bytes_add_up():
    """After any history the 256 continuations' probabilities add up to one."""
    symbols, bounds = cm.stream_of(*buffers(["abc abd abc xyz"]))
    tree = cm.Tree(np.bincount(cm.pairs_of(symbols), minlength=1 << 16).reshape(256, 256))
    counts = np.zeros((len(cm.ORDERS), 2 << cm.TABLE_BITS), np.uint32)
    cm.count_bits(tree, symbols, bounds, counts)
    odds = cm.log_odds(counts)
    base = np.frombuffer(bytes(cm.PAD) + b"abc ab", np.uint8)
    before = cm.score_stream(tree, odds, base, np.array([0, base.size]))[0]
    streams = np.concatenate([np.append(base, np.uint8(s)) for s in range(256)])
    after = cm.score_stream(tree, odds, streams, np.arange(257) * (base.size + 1))
    # the rows' last byte may fall into a block of its own: compare with one block only
    assert np.sum(2.0 ** -(after - before)) == pytest.approx(1, abs=2e-3)


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = cm.score_documents(df).collect()
    fold = {i: None if i is None else zlib.crc32(str(i).encode()) % 10 for i, _ in rows}
    count = Counter(w for i, t in rows if fold[i] not in (None, 0) for w in tokens_of(t))
    total, v = sum(count.values()), len(count)
    want = sorted((str(i), fold[i] == 0, len(tokens_of(t)), sum(count[w] > 0 for w in tokens_of(t)), total,
                   sum(math.log10((count[w] + 0.1) / (total + 0.1 * (v + 1))) for w in tokens_of(t))) for i, t in rows)
    have = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
                  for r in got)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert np.allclose([w[5] for w in want], [h[5] for h in have], rtol=1e-9)
    assert all(r["score"] < 0 for r in got)
    return got


def test_documents(documents, odd_documents, no_documents):
    got = check(documents)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 1.1 * sum(r["base_score"] for r in held)
    check(odd_documents)
    assert cm.score_documents(no_documents).count() == 0


def test_frequent_and_rare_words_in_many_ranges_and_blocks(documents, monkeypatch):
    monkeypatch.setattr(cm, "HOT_BITS", 6)
    monkeypatch.setattr(cm, "RANGE_ENTRIES", 1000)
    check(documents)
