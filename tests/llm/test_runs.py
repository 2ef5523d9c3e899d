import hashlib
import random
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from fixtures_llm import documents, no_documents, odd_documents  # noqa: F401

from penfit.llm import periodic_runs as pr


def plain_runs(w):
    """All lags, word by word."""
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            start, end = i, j + q
            if j > i and end - start >= max(24, 3 * q):
                s = w[start:end]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.add((start, end - start, q))
            i = j + 1
    return sorted(out)


def random_words(rng):
    letters = "abc"[:rng.choice([2, 3])]
    w = [rng.choice(letters) for _ in range(rng.randrange(0, 60))]
    for _ in range(rng.randrange(1, 5)):
        block = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 7, 15, 16, 17, 30, 31, 32, 47, 64, 100]))]
        if rng.random() < 0.4:  # a run inside the period of a longer one
            block = block + [rng.choice(letters)] * rng.randrange(1, 60)
        if rng.random() < 0.3:
            block = block + (block[:rng.randrange(1, 5)] * 12)
        w += block * rng.randrange(1, 6) + block[:rng.randrange(len(block))]
        w += [rng.choice(letters) for _ in range(rng.randrange(0, 30))]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_all_lags(seed):
    rng = random.Random(seed)
    texts = [random_words(rng) for _ in range(40)]
    for w, runs in zip(texts, pr.runs_of_texts(texts)):
        assert runs == plain_runs(w)


def test_periods_of_every_size_are_found():
    rng = random.Random(1)
    for q in list(range(1, 70)) + [96, 127, 128, 129, 255, 256, 300]:
        block = [str(rng.randrange(4)) for _ in range(q)]
        w = ["x"] * 3 + (block * 30)[:max(24, 3 * q)] + ["y"] * 3
        assert pr.runs_of_texts([w])[0] == plain_runs(w)


def test_one_word_many_times_and_a_long_text():
    w = [b"a"] * 200_000
    assert pr.runs_of_texts([w])[0] == [(0, 200_000, 1)]
    period = [b"w%d" % i for i in range(40_000)]
    assert pr.runs_of_texts([period * 3])[0] == [(0, 120_000, 40_000)]
    assert pr.runs_of_texts([period * 3 + period[:100], period * 2])[1] == []


def expected(doc_id, text):
    w = brute.words(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    ids = {x: i for i, x in enumerate(dict.fromkeys(w))}
    a = np.array([ids[x] for x in w], np.int64)
    runs = []
    for q in range(1, n // 3 + 1):  # lag by lag, vectorised: long texts
        eq = np.concatenate(([False], a[q:] == a[:-q], [False]))
        edge = np.flatnonzero(eq[1:] != eq[:-1])
        for s, e in zip(edge[::2], edge[1::2]):
            end = int(e) + q
            if end - s >= max(24, 3 * q):
                part = a[s:end]
                if not any(np.array_equal(part[d:], part[:-d]) for d in range(1, q)):
                    runs.append((int(s), int(end - s), q))
    runs.sort()
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("which", ["documents", "odd_documents"])
def test_documents(which, request):
    docs = request.getfixturevalue(which)
    short = docs.where("doc_id is null or length(text) < 20000 or text is null")
    rows = [(r["doc_id"], r["text"]) for r in short.collect()]
    got = pr.periodic_runs(short, prepare=pr.looped).collect()
    assert len(got) == len(rows)
    want = sorted([(str(i), *map(str, expected(i, t))) for i, t in rows])
    assert sorted([tuple(map(str, r)) for r in got]) == want
    assert which == "odd_documents" or any(r["n_runs"] for r in got)


def test_spans_and_empty(odd_documents, no_documents):
    assert pr.periodic_runs(no_documents).count() == 0
    spans = pr.run_spans(odd_documents).collect()
    assert (7, 0, 30000, 5) in {tuple(r) for r in spans}
    assert pr.periodic_runs(odd_documents).count() == odd_documents.count()
