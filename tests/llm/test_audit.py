import itertools

import brute
import numpy as np
from fixtures_llm import documents, no_documents, odd_documents  # noqa: F401

from penfit.llm import filter_audit as fa


def plain_masks(rows):
    out = []
    for i, t in rows:
        t = t or ""
        w = brute.words(t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w),
                 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t),
                 i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows)]
        out.append(sum(f << k for k, f in enumerate(fails)))
    return out


def plain_audit(rows, parts, labels):
    masks, out = plain_masks(rows), {}
    for p in set(parts):
        held = [(m, labels.get(i, (0, 0))) for m, q, (i, _) in zip(masks, parts, rows) if q == p]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = held
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                gone = [x for x in left if x[0] & bit]
                left = [x for x in left if not x[0] & bit]
                fails = sum(bool(m & bit) for m, _ in held)
                out[p, order, step] = [len(left), len(gone), fails - len(gone), sum(m == bit for m, _ in held),
                                       sum(g for _, (g, _) in gone), sum(t for _, (_, t) in gone)]
    for (p, order, step), v in out.items():
        c = order[step - 1]
        v.append(sum(w[1] for (q, o, s), w in out.items() if q == p and o[s - 1] == c))
    return out


def check(spark, docs, labels, rows):
    got = fa.audit_filters(docs, labels).collect()
    pairs = [(r["doc_id"], r["text"]) for r in rows]
    said = {}
    for r in labels.collect():
        if r["doc_id"] is not None:
            old = said.get(r["doc_id"], (0, 0))
            said[r["doc_id"]] = (max(old[0], int(r["quality"] == 1)), max(old[1], int(r["toxic"] == 1)))
    want = plain_audit(pairs, [r["lang"] or "" for r in rows], said)
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in map(tuple, got)} == want
    assert len(got) == len(want)


def test_against_step_by_step(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (10, 1, 1), (7, 1, None)],
                                   "doc_id bigint, quality int, toxic int")
    extra = spark.createDataFrame([(20, None, "en"), (21, "", None), (0, "word", "de"), (22, "A & B", "en"), (23, "ABC abc", "en"),
                                   (24, " ".join(f"w{i}" for i in range(100)), "en"), (25, " ".join(["a b"] * 60), "en")],
                                  "doc_id bigint, text string, lang string")
    docs = odd_documents.unionByName(extra, allowMissingColumns=True)
    check(spark, docs, labels.withColumn("mask", labels.doc_id), docs.collect())


def test_whole_table(spark, documents):
    check(spark, documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), documents.collect())


def test_a_hot_text_and_an_empty_table(spark, documents, no_documents):
    from pyspark.sql import functions as F
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert fa.audit_filters(no_documents, labels).count() == 0
    docs = documents.withColumn("text", F.when(F.col("doc_id") % 3 == 0, "one text").otherwise(F.col("text")))
    got = sorted(map(tuple, fa.failure_masks(docs).select("doc_id", "mask").collect()))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got == sorted((i, m) for (i, _), m in zip(rows, plain_masks(rows)))


def test_fields_add_up_without_carry():
    wide = fa.wide_counters()
    counts = {k: (1 << 40) + 7 * i for i, k in enumerate(wide)}
    total = fa.unpacked(sum(wide[k] * c for k, c in counts.items()))
    want = sum(fa.field_vector(*k).astype(np.int64) * c for k, c in counts.items())
    assert np.array_equal(total, want)
