import re
import time
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from fixtures_llm import documents, no_documents, odd_documents  # noqa: F401

from pyspark.sql import functions as F

from penfit.llm import (ann, exact_dedup, mixing, ngram_join, packing, placement, sharding,
                        token_counts, token_files, toxicity, url_filters)
from penfit.llm.common import stage
from penfit.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, tokenizer_path


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


# -- exact dedup ------------------------------------------------------------

def check_dedup(df):
    rows = rows_of(df)
    got = exact_dedup.exact_dedup(df, capacity=4).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    import hashlib
    best = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[3], len(v)) for k, v in groups.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == best[r["text_sha256"]]
    assert sum(r["kept"] for r in got) >= len(groups)


def test_dedup(documents, odd_documents):
    check_dedup(documents)
    check_dedup(odd_documents)


def test_dedup_keeps_one_row_of_a_group(odd_documents, no_documents):
    kept = rows_of(exact_dedup.deduplicated(odd_documents))
    assert len(kept) == len({norm(t) for _, t in rows_of(odd_documents)})
    assert exact_dedup.exact_dedup(no_documents).count() == 0
    assert exact_dedup.deduplicated(no_documents).count() == 0


def test_directory_splits_overfull_buckets(documents):
    links = exact_dedup.chain_links(exact_dedup.index_entries(documents))
    buckets = exact_dedup.directory(links, capacity=4)
    held = [tuple(r) for r in buckets.collect()]
    assert sum(n for *_, n in held) == links.count() and all(n <= 4 for *_, n in held)
    assert len({d for d, *_ in held}) > 1 and exact_dedup.global_depth(buckets) == max(d for d, *_ in held)
    # every link is in one bucket, tasks own whole buckets and chains are in them
    got = exact_dedup.owned(links, buckets).collect()
    assert len(got) == links.count()
    of = {}
    for r in got:
        of.setdefault((r["depth"], r["prefix"]), []).append(r["key"])
    assert sorted((d, p, len(k)) for (d, p), k in of.items()) == sorted(held)
    for (d, p), keys in of.items():
        assert all((k & (1 << 64) - 1) >> (64 - d) == p for k in keys) if d else True


@pytest.mark.parametrize("keep_bits,same_digest", [(0, False), (2, True)])
def test_collisions_are_chained(documents, odd_documents, keep_bits, same_digest):
    """Keys (and digests) that collide on purpose: groups stay right."""
    from pyspark.sql import functions as F

    def key(norm):  # neighbouring keys, so that buckets split down to the last bits
        return F.pmod(F.xxhash64(norm), F.lit(1 << keep_bits))

    def digest(norm):
        return F.lit("same") if same_digest else exact_dedup.digest_of(norm)

    for df in (documents, odd_documents):
        rows = rows_of(df)
        got = exact_dedup.exact_dedup(df, capacity=4, key=key, digest=digest).collect()
        assert len(got) == len(rows)
        groups = {}
        for i, t in rows:
            groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
        want = {}
        for v in groups.values():
            for *_, i in v:
                want.setdefault(i, set()).add((min(v)[3], len(v), i == min(v)[3]))
        assert all((r["keep_id"], r["group_size"], r["kept"]) in want[r["doc_id"]] for r in got)
        if not same_digest:  # one key: all links are one chain
            assert {r["chain"] for r in got} == set(range(len(groups)))


# -- n-gram join ------------------------------------------------------------

def check_near(df):
    rows = rows_of(df)
    sets, want = brute.near_components(rows)
    got = ngram_join.near_components(df, ranges=16).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got) == \
        sorted((i is None, i or 0, len(s), (want[k] or 0) if s else (i or 0))
               for k, ((i, _), s) in enumerate(zip(rows, sets)))


def test_near_components_against_all_pairs(documents, odd_documents, no_documents):
    check_near(documents)
    check_near(odd_documents)
    assert ngram_join.near_components(no_documents).count() == 0


def test_a_large_group_and_blocks_lose_no_link():
    rng = np.random.default_rng(1)
    base = rng.integers(1, 1 << 62, 100).astype(np.uint64)
    nodes = []
    for k in range(60):
        s = base.copy()
        at = rng.choice(100, rng.integers(0, 20), replace=False)
        s[at] = rng.integers(1, 1 << 62, at.size).astype(np.uint64)
        nodes.append((k, np.unique(s)))

    def connected(links):
        label = list(range(60))
        for a, b in links:
            x, y = label[a], label[b]
            label = [x if v == y else v for v in label]
        return {tuple(i for i in range(60) if label[i] == c) for c in set(label)}

    pairs = [(a, b) for a, s in nodes for b, t in nodes if a < b
             and 100 * np.intersect1d(s, t).size >= 75 * np.union1d(s, t).size]
    whole = ngram_join.block_links(nodes, None)
    halves = (ngram_join.block_links(nodes[:30], None) + ngram_join.block_links(nodes[30:], None)
              + ngram_join.block_links(nodes[:30], nodes[30:]))
    assert connected(whole) == connected(pairs) == connected(halves)
    assert len(whole) < 60  # a forest, not all pairs


@pytest.mark.parametrize("seed", range(4))
def test_prefixes_of_linked_sets_share_their_l(seed):
    rng = np.random.default_rng(seed)
    order = ngram_join.Order(rng.integers(0, 3000, 1 << ngram_join.SLOT_BITS).astype(np.uint32))
    for _ in range(200):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        cut = rng.random(a.size) < rng.uniform(0, 0.2)
        b = np.unique(np.where(cut, a ^ np.uint64(0x5DEECE66D), a))
        both = np.intersect1d(a, b).size
        if 100 * both >= 75 * (a.size + b.size - both):
            (pa, la), (pb, lb) = order.prefix(a), order.prefix(b)
            assert np.intersect1d(pa, pb).size >= min(la, lb)


def test_lists_of_classes_hold_every_pair():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 60, 2000).astype(np.uint64)
    nodes = rng.integers(0, 200, 2000)
    steps, ls = (nodes % 23).astype(np.uint8), (1 + nodes % 5).astype(np.uint8)  # a class has one of each
    want, chained = {}, set()
    lists, a, b = ngram_join.bucket_lists(tokens, nodes, ls, steps, small=6)
    assert all(len({tuple(r) for r in n.tolist()}) == len(n) for n, *_ in lists)
    for t in set(tokens.tolist()):
        held = sorted({(int(steps[i]), int(nodes[i])) for i in np.flatnonzero(tokens == t)})
        parts, last = [], None
        for x in held:
            if last is None or x[0] - last > ngram_join.SIZE_STEPS:
                parts.append([])
            parts[-1].append(x)
            last = x[0]
        for part in parts:
            if len(part) > 6:
                chained |= {tuple(sorted((x[1], y[1]))) for x, y in zip(part, part[1:])}
                continue
            for i, x in enumerate(part):
                for y in part[i + 1:]:
                    if y[0] - x[0] <= ngram_join.SIZE_STEPS:
                        k = tuple(sorted((x[1], y[1])))
                        want[k] = want.get(k, 0) + 1
    got = {}
    for part in lists:
        for x, y, l, m in zip(*[c.tolist() for c in ngram_join.list_pairs(*part)]):
            assert l == min(1 + x % 5, 1 + y % 5)
            got[x, y] = got.get((x, y), 0) + m
    assert got == want and set(zip(a.tolist(), b.tolist())) == chained and chained


def test_sets_of_families_are_shuffled_once(spark):
    rng = np.random.default_rng(12)
    bases = [rng.integers(0, 10_000, 60) for _ in range(4)]
    texts = []
    for k in range(120):  # near copies, some of them twice
        words = bases[k % 4].copy()
        words[rng.integers(0, 60)] = 20_000 + k // 2
        texts.append(" ".join(f"w{x}" for x in words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    sets = {ngram_join.set_key(s): s for s in ngram_join.sets_of_batch(*ngram_join.text_buffers(pa.array(texts)), 5)}
    keys = sorted(sets)
    one = spark.createDataFrame([(a, b) for a, b in zip(keys, keys[1:])], "a bigint, b bigint")
    sizes = spark.createDataFrame([(k, int(s.size)) for k, s in sets.items()], "node bigint, n bigint")
    pairs = [(a, b) for a in keys for b in keys if a < b and 100 * np.intersect1d(sets[a], sets[b]).size
             >= 75 * np.union1d(sets[a], sets[b]).size]

    def connected(links):
        label = {k: k for k in keys}
        for a, b in links:
            x, y = label[a], label[b]
            label = {k: x if v == y else v for k, v in label.items()}
        return {tuple(k for k in keys if label[k] == c) for c in set(label.values())}

    want = connected(pairs)
    for limits in ({}, {"most": 0}, {"block": 7}, {"block": 7, "most": 0}, {"block_shingles": 300},
                   {"block_shingles": 300, "most": 0}):
        links = ngram_join.family_links(df, one, sizes, **limits)
        assert connected([tuple(r) for r in links.collect()]) == want
        plan = links._jdf.queryExecution().sparkPlan().toString()
        assert ("Join" in plan) == ("most" in limits)  # the sets meet no table by a shuffle


def test_a_released_stage_leaves_no_shuffle_files(spark):
    def shuffled():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {str(b) for b in (blocks.apply(i) for i in range(blocks.size())) if str(b).startswith("shuffle_")}

    before = shuffled()
    got = stage(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "released", release=True)
    for _ in range(50):  # files go in the background
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and got.count() == 7
    stage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "kept")
    assert shuffled() - before


def test_one_row_of_a_component_stays(spark):
    rng = np.random.default_rng(8)
    text = {k: " ".join(f"{k}{x}" for x in rng.integers(0, 10_000, 120)) for k in "abcde"}
    rows = [(None, text["a"]), (None, text["a"] + " end"), (None, text["b"]), (None, text["b"] + " end"),
            (5, text["c"]), (5, text["c"] + " end"), (5, text["d"]), (3, text["d"] + " end"),
            (7, text["e"]), (7, text["e"]), (None, text["e"]), (8, ""), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rows_of(ngram_join.keep_one(df))
    words = [(i, t[0]) for i, t in got if t]
    assert sorted(words, key=str) == sorted([(None, "a"), (None, "b"), (5, "c"), (3, "d"), (7, "e")], key=str)
    assert sorted(i is None for i, t in got if not t) == [False, False, True]


# -- sharding ---------------------------------------------------------------

def check_shards(df, shards=16):
    got = sharding.shard_rows(df, shards=shards).collect()
    rows = rows_of(df)
    assert len(got) == len(rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
        (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(documents, odd_documents, no_documents):
    check_shards(documents)
    check_shards(odd_documents, 3)
    assert sharding.shard_rows(no_documents).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 226, 842])  # 226, 842: a cycle of surplus places only
def test_permutation_is_one(spark, n):
    got = sharding.permuted(spark.range(n), "id", n).collect()
    assert [r["place"] for r in sorted(got, key=lambda r: r["id"])] == plain_permutation(n)
    assert sorted(r["place"] for r in got) == list(range(n))


def plain_permutation(n, seed=sharding.SEED):
    """Places of 0..n-1 in plain arithmetic; a row walks until it is below n."""
    a, b = sharding.grid(n)
    mul, add, prime = sharding.MUL, sharding.ADD, sharding.PRIME

    def mixed(x, key):
        y = (x * mul + (key * 7919 + add) % prime) % prime
        return ((y * y + (key * 104729 + 7) % prime) % prime * mul + key) % prime

    def step(x):
        left, right = divmod(x, b)
        for i, key in enumerate(sharding.round_keys(seed)):
            if i % 2 == 0:
                left = (left + mixed(right, key)) % a
            else:
                right = (right + mixed(left, key)) % b
        return left * b + right

    out = []
    for i in range(n):
        x = step(i) if n > 1 else i
        while x >= n:
            x = step(x)
        out.append(x)
    return out


def test_every_walk_from_below_n_ends():
    for n in range(2, 2000):
        assert sorted(plain_permutation(n)) == list(range(n))


def test_the_plan_does_not_grow_with_the_rounds(spark):
    sizes = [len(sharding.permuted(spark.range(n), "id", n)._jdf.queryExecution().optimizedPlan().toString())
             for n in (10, 101, 226)]
    assert max(sizes) < 1.2 * min(sizes)


def test_numbers_of_a_hot_id_come_from_several_ranges(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 7, id)) as doc_id", "id % 2 as crc")
    got = sharding.numbered(rows, ["doc_id", "crc"], 16).collect()
    assert sorted(r["row_number"] for r in got) == list(range(3000))
    order = sorted(got, key=lambda r: r["row_number"])
    keys = [(r["doc_id"] is None, r["doc_id"] or 0, r["crc"]) for r in order]
    assert keys == sorted(keys)


# -- tokens -----------------------------------------------------------------

@pytest.fixture(scope="module", params=[WORD_BPE, BYTE_BPE])
def tokenizer(request):
    return Encoder(tokenizer_path(request.param))


def test_encoder_equals_the_library(tokenizer, documents):
    import random
    rnd = random.Random(3)
    al = [*" \n\t\r\x0b\x1c　́abzAZ09'.,!<|>éßİΣ三١‍😀", "<|endoftext|>", "'ll", "  "]
    texts = [t for _, t in rows_of(documents)][:60]
    texts += ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    want = tokenizer.library.encode_batch(texts, add_special_tokens=False)
    for t, w in zip(texts, want):
        assert tokenizer.encode(t) == np.array(w.ids, "<u4").tobytes(), repr(t)
        assert sum(len(tokenizer.piece_ids(p)) for u in
                   (token_counts.units(t)) for p in tokenizer.pre_tokens(u)) == len(w.ids)


def column_ids(e, column):
    out = []
    for n, ids, offsets in e.encode_column(column):
        assert len(offsets) == n + 1 and offsets[0] == 0 and offsets[-1] == ids.size
        out += [ids[offsets[k]:offsets[k + 1]].tolist() for k in range(n)]
    return out


def test_a_column_is_encoded_as_its_texts(tokenizer, documents, monkeypatch):
    import random

    import pyarrow as pa

    from penfit.llm import tokens
    rnd = random.Random(5)
    al = [*" \n\t\r\x0b\x1c\x85\xa0\u2003\u3000\u0301\u0338abzISAZ09'.,!=|<>éß×÷İıΣ三١\u200d😀", "<|endoftext|>",
          "<|startoftext|>", "'ll", "  ", " the", "word.", "É,", "İ."]
    texts = [t for _, t in rows_of(documents)][:60]
    texts += ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 30))) for _ in range(6000)]
    texts += [f"a{chr(c)}b {chr(c)}.{chr(c)}{chr(c)}'s,A{chr(c)}" for c in range(0x250)]
    want = [w.ids for w in tokenizer.library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(tokens, "COLUMN_UNITS", 300)
    for kind in (pa.string(), pa.large_string()):
        assert column_ids(tokenizer, pa.array(texts, kind)) == want
    holes = pa.array([None, "", *texts[:200], None, ""])
    assert column_ids(tokenizer, holes) == [[], [], *want[:200], [], []]
    assert column_ids(tokenizer, holes.slice(50, 100)) == want[48:148]
    assert column_ids(tokenizer, pa.array([], pa.string())) == []
    assert column_ids(tokenizer, pa.array([None, ""], pa.string())) == [[], []]
    monkeypatch.setattr(tokens, "LONG_TEXT", 100)
    assert column_ids(tokenizer, pa.array(texts[:80])) == want[:80]


def test_missing_units_share_a_call(monkeypatch):
    import pyarrow as pa
    e = Encoder(tokenizer_path(BYTE_BPE))
    texts = ["One two, three.\nÉté où?", "Four's five!"]
    want = [w.ids for w in e.library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(e, "piece_ids", None)  # no unit goes through the model on its own
    assert column_ids(e, pa.array(texts)) == want


def test_token_counts(documents, odd_documents, no_documents):
    library = Encoder(tokenizer_path(BYTE_BPE)).library
    for df, hot in ((documents, 50), (odd_documents, 1 << 19)):
        want = sorted((i is None, i or 0, len((t or "").encode()),
                       len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows_of(df))
        got = token_counts.count_tokens(df, hot=hot).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count_tokens(no_documents).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, documents, odd_documents, no_documents, encoding):
    library = Encoder(tokenizer_path(WORD_BPE)).library
    for df in (documents, odd_documents, no_documents):
        path = token_files.write_tokens(df, token_files.new_token_path(spark), encoding=encoding, docs_per_part=40)
        rows = sorted(rows_of(df), key=lambda r: (r[0] is None, r[0] or 0))
        ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in rows]
        got = sorted(token_files.token_digest(token_files.read_documents(spark, path)).collect(),
                     key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == [i for i, _ in rows]
        assert [r["n_tokens"] for r in got] == [x.size for x in ids]
        assert [r["start"] for r in got] == [sum(x.size for x in ids[:k]) for k in range(len(ids))]
        assert sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(x.tobytes()) for x in ids)
        assert token_files.read_metadata(spark, path).count() == len(rows)


def test_selective_token_reads(spark, documents):
    path = token_files.write_tokens(documents, token_files.new_token_path(spark), docs_per_part=40)
    rows = sorted(rows_of(documents))
    library = Encoder(tokenizer_path(WORD_BPE)).library
    stream = np.concatenate([library.encode(t, add_special_tokens=False).ids + [2] for _, t in rows])
    got = sorted(token_files.read_tokens(spark, path, 700, 5000).collect(), key=lambda r: r["start"])
    assert np.array_equal(np.concatenate([r["tokens"] for r in got]), stream[700:5700])
    one = token_files.read_documents(spark, path, [rows[5][0]])
    assert one.count() == 1
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().toString()
    assert not re.search(r"[\[,]tokens#", plan.split("== Physical Plan ==")[1])


def test_a_part_is_encoded_by_columns(monkeypatch):
    import pyarrow as pa

    from penfit.llm import tokens
    texts = ["one two", None, "three", "", "four five six, seven", "eight.", "nine ten"]
    parts, path = [0, 0, 0, 1, 1, 1, 4], tokenizer_path(WORD_BPE)
    library = Encoder(path).library
    want = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 12)
    monkeypatch.setattr(Encoder, "encode", None)  # no text goes alone
    batch = pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(range(7), pa.int64()), pa.array(texts)],
                                       names=["part", "doc_id", "text"])
    made = list(token_files._encode_part(path, 2)([batch.slice(0, 2), batch.slice(2)]))
    got = [r for b in made for r in b.to_pylist()]
    assert len(made) > 2 and [r["tokens"] for r in got] == want
    assert [(r["part"], r["doc_id"], r["n_tokens"]) for r in got] == list(zip(parts, range(7), map(len, want)))
    assert [r["start_in_part"] for r in got] == [
        sum(len(w) for w, p in zip(want[:k], parts) if p == parts[k]) for k in range(7)]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_file_footers(spark, documents, encoding):
    import pyarrow.parquet as pq
    path = token_files.write_tokens(documents, token_files.new_token_path(spark), encoding=encoding, docs_per_part=100,
                                    row_group_bytes=256 << 10, page_bytes=16 << 10, page_rows=20)
    files = [r[0] for r in spark.read.parquet(f"{path}/tokens").select("_metadata.file_path").distinct().collect()]
    groups = 0
    for f in files:
        meta = pq.ParquetFile(f.replace("file://", "")).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_offset_index and col.has_column_index
                if col.path_in_schema.startswith("tokens"):
                    assert ("RLE_DICTIONARY" in col.encodings) == (encoding == "dictionary")
                if not col.path_in_schema.startswith("tokens") or encoding == "delta":
                    assert "DELTA_BINARY_PACKED" in col.encodings
    assert groups >= len(files) >= 2


def test_a_hot_id_is_cut_into_several_files(spark):
    rows = [(7 if i % 3 else None, f"text number {i % 50}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = token_files.write_tokens(df, token_files.new_token_path(spark), docs_per_part=30)
    held = [r["documents"] for r in spark.read.parquet(f"{path}/parts").collect()]
    assert sum(held) == 300 and len(held) >= 5 and max(held) <= 120
    got = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [7] * 200 + [None] * 100
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


# -- packing ----------------------------------------------------------------

def check_packing(df, **settings):
    library = Encoder(tokenizer_path(BYTE_BPE)).library
    rows = rows_of(df)
    ids = [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in rows]
    got = packing.pack_documents(df, **settings).collect()
    assert sum(r["length"] for r in got) == sum(x.size for x in ids)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    repeated = {k for k in by_doc if [(i, x.size) for (i, _), x in zip(rows, ids)].count(k) > 1}
    for (i, _), x in zip(rows, ids):
        if (i, x.size) in repeated:
            continue
        at = 0
        for r in sorted(by_doc[(i, x.size)], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(x[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == x.size
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return by_seq


def test_packing(documents, odd_documents, no_documents):
    seqs = check_packing(documents)
    assert sum(sum(r["length"] for r in s) < 2048 for s in seqs.values()) <= 1
    check_packing(documents, shard_tokens=20_000)
    check_packing(odd_documents)
    assert packing.pack_documents(no_documents).count() == 0


def test_windows_take_the_lexical_neighbours():
    a, b = np.arange(100, 200), np.arange(300, 400)
    items = [np.r_[a, a], np.r_[b, b], np.r_[a, [7]], np.r_[b, [8]]]
    got = packing.fill_windows(items, np.ones(500), window=301)
    assert {i for i, _, _ in got[0]} in ({0, 2}, {1, 3})


def test_windows_take_all_neighbours_before_unrelated_items():
    items = [np.array([5, 100 + i]) for i in range(120)] + [np.arange(300, 400), np.arange(400, 500)]
    got = packing.fill_windows(items, np.ones(600), window=160)
    with_5 = [s for s in got if any(i < 120 for i, _, _ in s)]
    assert sum(all(i < 120 for i, _, _ in s) for s in with_5) == len(with_5) - 1  # one holds the last of them


def test_related_documents_share_a_shard(spark):
    import random
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    topics = [[word() for _ in range(40)] for _ in range(12)]
    rows = [(i, " ".join(rnd.choice(topics[i % 12]) for _ in range(120))) for i in range(360)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = packing.pack_documents(df, shard_tokens=30_000).collect()
    shards = [{r["sequence_id"] >> 32 for r in got if r["doc_id"] % 12 == t} for t in range(12)]
    assert len(set.union(*shards)) >= 6
    assert sum(len(s) == 1 for s in shards) >= 8 and all(len(s) <= 2 for s in shards)
    assert sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())


def test_hot_groups_are_split_over_shards(spark):
    cells = [(0, 0, 40), (0, 9, 50), (1, 3, 950), (1, 4, 60), (2, 0, 30)]
    assert placement.deal(cells, 100) == [(0, 0, 0, 1), (0, 9, 0, 1), (1, 3, 1, 10), (1, 4, 11, 1), (2, 0, 11, 1)]
    df = spark.createDataFrame([(i, "the same text " * 20) for i in range(300)], "doc_id bigint, text string")
    got = packing.pack_documents(df, shard_tokens=4_000).collect()
    held = {}
    for r in got:
        held[r["sequence_id"] >> 32] = held.get(r["sequence_id"] >> 32, 0) + r["length"]
    assert len(held) > 3 and max(held.values()) < 8_000


# -- mixing -----------------------------------------------------------------

def check_mix(df, **settings):
    rows = df.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    want = brute.targets(sizes)
    got = mixing.taken_words(*mixing.mix(df, **settings)).collect()
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-12, abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"]) for r in got)


def test_mix(documents, odd_documents, no_documents):
    first = check_mix(documents, block_words=32, shard_slots=64)
    assert first == check_mix(documents.repartition(5), block_words=32, shard_slots=64)
    check_mix(odd_documents, block_words=16)
    assert mixing.taken_words(*mixing.mix(no_documents)).count() == 0


def test_mixed_texts_hold_the_taken_words(documents):
    got = mixing.mixed_documents(documents, block_words=32).collect()
    spans = mixing.mix(documents, block_words=32)[1]
    assert sum(len(brute.words(r["text"])) for r in got) == spans.groupBy().sum("words").first()[0]
    texts = dict(rows_of(documents))
    whole = [r for r in got if r["text"] == texts[r["doc_id"]]]
    assert whole and all(r["n_chars"] == len(r["text"]) for r in got)


def test_one_id_and_text_under_two_sources(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text, "en", "x", 1), (1, text, "de", "y", 1), (1, text, "en", "x", 1), (2, "other words", "en", None, 1),
            (None, text, "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.mixed_documents(docs, block_words=16).collect()
    documents, spans = mixing.mix(docs, block_words=16)
    want = {}
    for r in mixing.taken_words(documents, spans).collect():
        want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + r["taken"]
    have = {k: 0 for k in want}
    for r in got:
        found = brute.words(r["text"])
        assert len(found) == len(set(found))  # no word twice in one epoch of one row
        have[r["doc_id"], r["source"]] += len(found)
    assert have == want


def test_slots_and_blocks_meet_in_a_shuffle_join(documents):
    plan = mixing.mix(documents)[1]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_permute_and_shard_counts():
    for n in (1, 2, 5, 97, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(got) == list(range(n))
    counts = np.array([700, 200, 55])
    parts = [mixing.shard_counts(s, 10, 100, counts, 3) for s in range(10)]
    assert np.array_equal(sum(h for _, h in parts), counts)
    assert [int(h.sum()) for _, h in parts] == [100] * 9 + [55]
    assert np.array_equal(parts[4][0], sum(h for _, h in parts[:4]))


# -- neighbours -------------------------------------------------------------

def test_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e).collect()
    p = e.toPandas()
    x, ids = np.array(p["embedding"].tolist(), np.float64), p["vec_id"].to_numpy()
    q = np.flatnonzero(ids % 20 == 0)
    s = x[q] @ x.T
    s[np.arange(q.size), q] = -np.inf
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = 0
    for i, k in enumerate(q):
        best = ids[np.lexsort((ids, -s[i]))[:20]]
        mine = found[ids[k]]
        assert sorted(mine) == list(range(1, 21))
        hits += len(set(best) & {v for v, _ in mine.values()})
        for v, score in mine.values():
            assert score == pytest.approx(float(x[k] @ x[np.flatnonzero(ids == v)[0]]), abs=1e-12)
    assert hits / (20 * q.size) >= 0.9


def test_lists_of_several_chunks_and_query_parts(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((900, 8)), 1)  # ties, also of bars
    x[100:160] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = ann.search(df, every=5, probe_share=1.0, first_probes=1, list_rows=450, chunk_rows=100, query_rows=25).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(found) == 180
    for q, rows in found.items():
        s = x @ x[q]
        want = sorted((-s[i], i) for i in range(900) if i != q)[:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21))
        assert np.allclose([-w[0] for w in want], [r[2] for r in rows])
        # ties to the smaller id, up to the last bit of the sums
        assert all(abs(s[i] - s[w[1]]) < 1e-9 for (_, i, _), w in zip(rows, want))


def test_a_query_goes_to_a_cell_once():
    rng = np.random.default_rng(6)
    lists, dims = 300, 4
    centroids, x = rng.standard_normal((lists, dims)), rng.standard_normal((700, dims))
    b = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), pa.array(x.tolist())], names=["vec_id", "v"])
    probed = list(ann._probe(centroids, dims, 4, 195)([b]))
    first, count, cells = ann.cells_of(rng.integers(0, 50, lists) + 990 * (np.arange(lists) == 7), 400)
    assert cells[first[7]] == [7] and count[7] == 3 and sorted(set(sum(cells, []))) == list(range(lists))
    got = pa.Table.from_batches(probed).append_column("bar", pa.array(np.zeros(700))).select(["vec_id", "v", "late", "bar"])
    out = list(ann._to_cells(cells, lists)(got.to_batches()))
    # no batch holds a vector for each probed list
    assert max(r.num_rows for r in probed + out) <= ann.SLICE and sum(r.num_rows for r in out) <= 700 * len(cells)
    asked = {i: set() for i in range(700)}
    for r in out:
        own = cells[r.column(0)[0].as_py()]
        for i, bits in zip(r.column(1).to_pylist(), r.column(4).to_pylist()):
            asked[i] |= {own[k] for k in np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)))}
    far = 0.5 * (centroids ** 2).sum(1) - x @ centroids.T
    best = np.argsort(far, axis=1, kind="stable")
    near = sum((r.column(2).to_pylist() for r in probed), [])
    assert all(asked[i] == set(best[i, 4:195]) and near[i] == best[i, :4].tolist() for i in range(700))


def test_a_cell_holds_the_best_of_its_lists():
    rng = np.random.default_rng(7)
    x, lists, ids = np.round(rng.standard_normal((600, 8)), 1), rng.integers(0, 6, 600), rng.permutation(600)
    q, qids, asks = x[:90], ids[:90], rng.random((90, 6)) < 0.6
    bars = np.where(rng.random(90) < 0.5, -np.inf, 1.0)
    got = ann.search_cell(lists, ids, x, list(range(6)), qids, q, bars, asks, ann.rotation(8), 5, 40, 8, 2.1)
    found = {}
    for i, v, s in zip(*got):
        found.setdefault(i, []).append((-s, v))
    for i in range(90):
        s = x @ q[i]
        want = sorted(-s[j] for j in range(600) if asks[i, lists[j]] and ids[j] != qids[i] and s[j] >= bars[i] - 1e-12)[:5]
        assert np.allclose([a for a, _ in sorted(found.get(qids[i], []))], want)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1),
            (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1),
            (20, [float("inf"), 1.0], 1), (40, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 9, 1.0), (0, 4, 40, 1.0), (0, 5, 2, 0.0),
                   (40, 1, 0, 1.0), (40, 2, 1, 1.0), (40, 3, 9, 1.0), (40, 4, 9, 1.0), (40, 5, 2, 0.0)]
    assert ann.search(df.limit(0)).count() == 0


# -- url filters ------------------------------------------------------------

def test_url_filters(spark):
    events = spark.createDataFrame(
        [("bad.com", "add", "2024-01-10"), ("bad.com", "remove", "2024-02-10"), ("bad.com", "add", "2024-03-10"),
         ("bad.com", "add", "2024-03-12"), ("x.org/ads", "add", "2024-01-01"), (None, "add", "2024-01-01"),
         ("ok.com", "other", "2024-01-01"), ("late.com", "add", None)], "entry string, action string, at string")
    cases = [("http://www.Bad.com/a", "2024-01-09", False), ("http://bad.com/a", "2024-01-10", True),
             ("https://u:p@sub.bad.com:80/x?y", "2024-02-09", True), ("http://bad.com./", "2024-02-10", False),
             ("http://notbad.com/", "2024-01-20", False), ("http://bad.com", "2030-01-01", True),
             ("http://x.org/ads/1", "2024-05-05", True), ("http://x.org/adsx", "2024-05-05", False),
             (None, "2024-05-05", False), ("", "2024-05-05", False), ("not a url", "2024-05-05", False),
             ("http://bad.com/a", None, False), ("http://late.com/", "2024-05-05", False)]
    pages = spark.createDataFrame([(i, u, d) for i, (u, d, _) in enumerate(cases)] + [(0, *cases[0][:2])],
                                  "page_id bigint, url string, fetched string")
    got = url_filters.filter_urls(pages, events).collect()
    assert len(got) == len(cases) + 1
    assert all(r["blocked"] == cases[r["page_id"]][2] for r in got)
    assert url_filters.filter_urls(pages.limit(0), events).count() == 0
    assert url_filters.filter_urls(pages, events.limit(0)).where("blocked").count() == 0


def test_segments_keep_their_case(spark):
    events = spark.createDataFrame([("X.org/Ads", "add", "2024-01-01"), ("Bad.COM", "add", "2024-01-01"),
                                    ("y.org/Ads", "add", "2024-01-01"), ("Y.org/Ads", "remove", "2024-03-01"),
                                    ("y.org/ads", "add", "2024-01-01")], "entry string, action string, at string")
    cases = [("http://x.org/Ads/1", True), ("http://X.ORG/Ads?q", True), ("http://x.org/ads/1", False),
             ("http://bad.com/A", True), ("http://y.org/Ads/1", False), ("http://y.org/ads/1", True)]
    pages = spark.createDataFrame([(i, u, "2024-05-05") for i, (u, _) in enumerate(cases)],
                                  "page_id bigint, url string, fetched string")
    got = url_filters.filter_urls(pages, events).collect()
    assert sorted((r["page_id"], r["blocked"]) for r in got) == [(i, b) for i, (_, b) in enumerate(cases)]


def test_entries_are_normalised_like_hosts(spark):
    events = spark.createDataFrame([(e, "add", "2024-01-01") for e in (
        "www.bad.com", "worse.com:80", "dot.com.", "u@user.com", "http://scheme.org/a/", "root.org/", "", "/x", " sp.com ")],
        "entry string, action string, at string")
    cases = [("http://bad.com/a", True), ("http://www.bad.com", True), ("http://worse.com", True), ("http://dot.com/", True),
             ("http://user.com/q", True), ("http://scheme.org/a/b", True), ("http://scheme.org/b", False),
             ("http://root.org/", True), ("http://root.org/x", False), ("http://sp.com/", True), ("http://x/x", False)]
    pages = spark.createDataFrame([(i, u, "2024-05-05") for i, (u, _) in enumerate(cases)],
                                  "page_id bigint, url string, fetched string")
    clash = [c for c in ("host", "segment", "entry", "spans", "valid_from", "blocked")]
    from pyspark.sql import functions as F
    for c in clash:
        pages = pages.withColumn(c, F.lit("clash"))
    events = events.withColumn("valid_to", F.lit("clash")).union(events.withColumn("valid_to", F.lit("clash")))
    got = url_filters.filter_urls(pages, events).collect()
    assert sorted((r["page_id"], r["blocked"]) for r in got) == [(i, b) for i, (_, b) in enumerate(cases)]
    deep = spark.createDataFrame([("x.org/a/b", "add", "2024-01-01")], "entry string, action string, at string")
    with pytest.raises(Exception, match="more than one path segment"):
        url_filters.filter_urls(pages, deep).collect()


# -- toxicity ---------------------------------------------------------------

def test_toxicity(spark, odd_documents, no_documents):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_documents(docs, labels, max_labelled=3000).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in got)
    assert hit >= 0.55 * sum(r["toxic"] for r in got)
    assert hit >= 0.5 * sum(r["predicted"] for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    odd = toxicity.score_documents(odd_documents, labels).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.score_documents(no_documents, labels).count() == 0
    assert {r["score"] for r in toxicity.score_documents(odd_documents, labels.limit(0)).collect()} == {0.0}
    assert toxicity.keep_clean(odd_documents, labels).columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_held_out_labels_are_not_read(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    from pyspark.sql import functions as F
    flipped = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    assert toxicity.train(docs, labels) == toxicity.train(docs, flipped)


def test_latin_words_need_no_library_normaliser():
    e = Encoder(tokenizer_path(WORD_BPE))
    text, library = "ÉTÉ, ça_va 'Où'LL ²³½ ŸÅŉ", e.library
    odd = " İi a\u030b É\x85É\u00a0é \x1cÀ Σας"
    assert np.frombuffer(e.encode(text + odd), "<u4").tolist() == library.encode(text + odd, add_special_tokens=False).ids
    e.library, e.young, e.old = None, {}, {}  # neither normalised nor split by it
    assert np.frombuffer(e.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
