r"""Exact duplicates by an extendible-hash index on shared files (DataFrame and
SQL functions only).

Key of a text: ``xxhash64`` of its normalised form (every character of
``[\x20\x09-\x0D]`` deleted). The index is built in four steps:

1. Entries ``(key, doc_id, code points, SHA-256)`` are computed in one scan of
   the texts and written to the shared folder. No text is written. They are
   aggregated to chain links, one per (key, digest), with the group's size and the row
   that stays; the partial aggregate runs before the shuffle, so a group of
   copies with a third of all rows sends one row per task.
2. Directory: a bucket is a prefix of the keys' bits. The first directory has
   as many buckets as links fill at ``capacity``; a bucket with more links is
   split by one more bit, which doubles the directory if the bucket's depth was the global
   depth, and so on until none is overfull (a bucket of one key can't be split: its
   links are a chain). Every round counts the overfull buckets' links alone. The capacity
   is at least a 2**``directory_bits``-th of the links, so the directory has a bounded
   size for any input, while its depth has no bound but the 64 bits of a key.
3. Owner tasks: links are routed to their bucket through the directory and dealt to
   tasks by ranges of buckets, so a task owns whole buckets. Inside a bucket, links
   with the same key and different digests form a chain, in the order of the
   digests. The index files are written in this order.
4. Bytes are compared: for every link of two rows or more the texts are read
   again and grouped by (key, normalised bytes), again with a partial
   aggregate first. A link whose digests agree but whose bytes differ is not
   trusted: its rows are chained by their bytes instead.

Null texts count as empty. Ties on code points go to the smallest doc_id; a
null doc_id loses every tie. Repeated rows each get a row of output. An empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from penfit.llm.common import pick, pick_documents, stage

CAPACITY = 4096
DIRECTORY_BITS = 14
HOT_PARTS = 1024
COMPARE_SLOTS = 1 << 20


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def key_of(norm):
    return F.xxhash64(norm)


def digest_of(norm):
    return F.sha2(norm.cast("binary"), 256)


def index_entries(docs: DataFrame, key=key_of, digest=digest_of) -> DataFrame:
    """(doc_id, points, key, sha) of every row; texts do not travel further."""
    norm = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("points"),
                       normalised(F.col("text")).alias("norm"))
    return norm.select("doc_id", "points", key(F.col("norm")).alias("key"), digest(F.col("norm")).alias("sha"))


def _prefix(key, depth: int):
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")


def directory(links: DataFrame, capacity: int = CAPACITY, bits: int = DIRECTORY_BITS) -> DataFrame:
    """(depth, prefix, held): the buckets, with the number of their links."""
    total = links.count()
    capacity = max(capacity, -(-total >> bits))
    depth = 0
    while capacity << depth < total and depth < 64:
        depth += 1
    held = stage(links.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(
        F.count("*").alias("held"), (F.min("key") < F.max("key")).alias("splits")), "dedup-directory")
    done, open_keys = [], links.select("key")
    while True:
        over = held.where((F.col("held") > capacity) & F.col("splits"))
        done.append(held.where((F.col("held") <= capacity) | ~F.col("splits")).select(
            F.lit(depth).alias("depth"), "prefix", "held"))
        if depth == 64 or over.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        # the overfull buckets (at most total / capacity of them) are split by one more bit
        open_keys = open_keys.where("key is not null").join(
            F.broadcast(over.select(F.col("prefix").alias("_p"))), _prefix(F.col("key"), depth) == F.col("_p")).select("key")
        depth += 1
        held = stage(open_keys.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(
            F.count("*").alias("held"), (F.min("key") < F.max("key")).alias("splits")), "dedup-directory")


def global_depth(buckets: DataFrame) -> int:
    """Depth of the directory (1 row to the driver)."""
    got = buckets.agg(F.max("depth")).first()[0]
    return int(got or 0)


def routed(links: DataFrame, buckets: DataFrame) -> DataFrame:
    """Links with the depth and prefix of their bucket, and ``first``, the place of the
    bucket's key range. One directory look-up per depth in use; the directory's size is
    bounded (see the module's head)."""
    depths = [r[0] for r in buckets.select("depth").distinct().orderBy("depth").collect()]  # at most 65
    if not depths:
        return links.select("*", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("prefix"),
                            F.lit(0).cast("bigint").alias("first"))
    at = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.col("key"), d).alias("prefix")) for d in depths])
    asked = links.select("*", F.explode(at).alias("_at")).select(*links.columns, "_at.depth", "_at.prefix")
    found = asked.join(F.broadcast(buckets.select("depth", "prefix")), ["depth", "prefix"])
    # the first key of the bucket, as a signed number in the order of unsigned ones
    place = functools.reduce(lambda c, d: F.when(F.col("depth") == d, F.shiftleft("prefix", 64 - d) if d else F.lit(0)
                                                 .cast("bigint")).otherwise(c), depths, F.lit(0).cast("bigint"))
    return found.withColumn("first", place.bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")))


def _best():
    """The row that stays: most code points, then smallest doc_id (null last)."""
    return F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"),
                          F.col("doc_id"))).alias("best")


def chain_links(entries: DataFrame) -> DataFrame:
    """One row per (key, sha): the group's size and the row that stays."""
    return entries.groupBy("key", "sha").agg(F.count("*").alias("group_size"), _best())


def owned(links: DataFrame, buckets: DataFrame) -> DataFrame:
    """The index: links dealt to owner tasks by ranges of buckets, in the order of bucket,
    key and digest, with their place in the chain of their key (``chain``, from 0).
    A bucket's rows are at most its capacity, or the chain of one key."""
    dealt = routed(links, buckets).repartitionByRange("first", "depth")
    chain = Window.partitionBy("first", "depth", "key").orderBy("sha")
    return dealt.withColumn("chain", F.row_number().over(chain) - 1)


def compared(docs: DataFrame, links: DataFrame, slots: int = COMPARE_SLOTS, key=key_of,
             digest=digest_of) -> DataFrame:
    """Byte comparison inside every link of two or more rows: (key, sha,
    classes), where ``classes`` is the number of different normalised texts.

    Only texts whose key falls into a slot of a doubtful key are moved (the
    broadcast side has at most ``slots`` numbers, whatever the input), and a
    partial aggregate leaves one row per different text and task first. Equal
    texts meet in the hash aggregate, which compares their bytes.
    """
    many = links.where("group_size > 1").select("key", "sha")
    slot = F.pmod(F.col("key"), F.lit(slots))
    doubtful = many.select(slot.alias("slot")).distinct()
    texts = docs.select(normalised(F.col("text")).alias("norm")).withColumn("key", key(F.col("norm")))
    near = texts.withColumn("slot", slot).join(F.broadcast(doubtful), "slot", "left_semi")
    same = near.groupBy("key", "norm").agg(F.count("*").alias("rows"))
    sure = same.select("key", digest(F.col("norm")).alias("sha"), "rows")
    return many.join(sure, ["key", "sha"], "left").groupBy("key", "sha").agg(
        F.count("rows").alias("classes"))


def by_bytes(docs: DataFrame, doubtful: DataFrame, key=key_of, digest=digest_of) -> DataFrame:
    """Result rows of the links whose bytes differ (none, unless a digest collides): their
    texts are read again and chained by their bytes."""
    texts = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("points"),
                        normalised(F.col("text")).alias("norm"))
    texts = texts.select("*", key(F.col("norm")).alias("key"), digest(F.col("norm")).alias("sha"))
    mine = texts.join(doubtful.select("key", "sha", "depth"), ["key", "sha"])
    groups = mine.groupBy("key", "sha", "norm").agg(F.count("*").alias("group_size"), _best())
    chain = Window.partitionBy("key", "sha").orderBy("norm")
    groups = groups.withColumn("chain", F.row_number().over(chain) - 1)
    return _rows(mine.join(groups, ["key", "sha", "norm"]), F.sha2(F.col("norm").cast("binary"), 256))


def _rows(joined: DataFrame, sha) -> DataFrame:
    same_id = F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    return joined.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (same_id & (F.col("points") == -F.col("best.less"))).alias("kept"), sha.alias("text_sha256"), "depth", "chain")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, bits: int = DIRECTORY_BITS, key=key_of, digest=digest_of) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256,
    plus depth (of the bucket that holds the row) and chain (place in its chain).

    ``kept`` marks one row of each group; of fully repeated rows (same doc_id
    and text) every copy has ``kept`` true, as nothing tells them apart.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    entries = stage(index_entries(docs, key, digest), "dedup-entries")
    chains = stage(chain_links(entries), "dedup-chains")
    links = stage(owned(chains, directory(chains, capacity, bits)), "dedup-index")
    checked = compared(docs, links, key=key, digest=digest)
    links = stage(links.join(checked, ["key", "sha"], "left").select(
        "key", "sha", "group_size", "best", "depth", "chain",
        (F.coalesce("classes", F.lit(1)) == 1).alias("sound")), "dedup-links")
    total = entries.count()
    # At most HOT_PARTS groups hold a HOT_PARTS-th of all rows each: a proven
    # bound for the broadcast; all other groups meet their rows in a shuffle.
    is_hot = F.col("group_size") > F.lit(max(1, total // HOT_PARTS))
    sound = links.where("sound").drop("sound")
    hot = sound.where(is_hot)
    rows_hot = entries.join(F.broadcast(hot), ["key", "sha"])
    rows_cold = (entries.join(F.broadcast(hot.select("key", "sha")), ["key", "sha"], "left_anti")
                 .join(sound.where(~is_hot), ["key", "sha"]))
    rows = _rows(rows_hot.unionByName(rows_cold), F.col("sha"))
    doubtful = links.where("not sound")
    if doubtful.isEmpty():
        return rows
    return rows.unionByName(by_bytes(docs, doubtful, key, digest))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The row that stays of each group, with the five columns of documents."""
    docs = pick_documents(docs)
    none = F.lit(-(1 << 63))
    kept = exact_dedup(docs).where("kept").select(
        F.coalesce("doc_id", none).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select("*", F.coalesce("doc_id", none).alias("_id"),
                       F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("_sha"),
                       F.length("text").alias("_points")).join(kept, ["_id", "_sha"], "left_semi")
    # rows that share id and normalised text: the one with the most code points
    first = Window.partitionBy("_id", "_sha").orderBy(F.desc_nulls_last("_points"), "text")
    return rows.withColumn("_place", F.row_number().over(first)).where("_place = 1").drop(
        "_id", "_sha", "_points", "_place")
