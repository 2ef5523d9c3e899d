"""Helpers shared by the operators: column picking that survives clashing
names, staged tables in the shared folder, distributed row numbers."""

from __future__ import annotations

import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penfit.session import ship_package, unique_path

DOCUMENT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string",
                    "source": "string", "n_chars": "bigint"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new_name=old_name`` by exact, then case-insensitive name.

    Other columns of the input are left out before anything else happens, so
    none of them (also not one that differs only in case, or one called like
    an internal column) can clash with what an operator adds.
    """
    names = df.columns
    if len({c.lower() for c in names}) == len(names):
        frame, places = df, names
    else:
        places = [f"_c{i}" for i in range(len(names))]
        frame = df.toDF(*places)
    out = []
    for new, old in columns.items():
        at = [i for i, c in enumerate(names) if c == old] or \
             [i for i, c in enumerate(names) if c.lower() == old.lower()]
        if not at:
            raise ValueError(f"column {old!r} not found in {names}")
        name = places[at[0]].replace("`", "``")
        out.append(frame[f"`{name}`"].alias(new))
    return frame.select(*out)


def pick_documents(df: DataFrame) -> DataFrame:
    """The five columns of ``documents`` in their order and types; a column
    that the input lacks is null."""
    have = {c.lower() for c in df.columns}
    got = pick(df, **{c: c for c in DOCUMENT_COLUMNS if c in have})
    return got.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
                        for c, t in DOCUMENT_COLUMNS.items()])


#: Spark's setting that removes the shuffle files of a query when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage is cut,
    and a lost executor re-reads files instead of recomputing. With ``release``
    the write's shuffle files go once the table is written, not when the driver
    happens to collect its garbage."""
    spark = df.sparkSession
    path = unique_path(spark, f"{name}")
    if release:
        before = spark.conf.get(RELEASE, None)
        spark.conf.set(RELEASE, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def xor_all(*cols: Column) -> Column:
    return functools.reduce(lambda a, b: a.bitwiseXOR(b), cols)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_id() -> str:
    return uuid.uuid4().hex[:12]


def cut_points(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts - 1`` increasing values that cut ``column`` (a number)
    into ranges of similar row counts. Nulls are ignored."""
    if parts <= 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    got = df.approxQuantile(column, probs, 0.1 / parts)
    return sorted(set(int(x) for x in got))


def range_bucket(column: Column, cuts: list) -> Column:
    """Number of cut points at or below the value; null goes after all.
    Equal values share a bucket and buckets follow the order of values."""
    if not cuts:
        return F.when(column.isNull(), F.lit(1)).otherwise(F.lit(0))
    # a binary search over the cuts: depth log2(parts), no array scan per row
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))
    return F.when(column.isNull(), F.lit(len(cuts) + 1)).otherwise(search(0, len(cuts)))


def prefix_of_buckets(totals: DataFrame, bucket: str, value: str, out: str,
                      by: list[str] = ()) -> DataFrame:
    """Exclusive running sum of ``value`` over ``bucket`` (one row per range,
    so the table is as small as the number of ranges)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast("bigint")))


def all_of(conditions) -> Column:
    return functools.reduce(operator.and_, conditions)


__all__ = ["DOCUMENT_COLUMNS", "read_table", "pick", "pick_documents", "stage", "ship_package",
           "unique_path", "xor_all", "shuffle_partitions", "new_id", "cut_points",
           "range_bucket", "prefix_of_buckets", "all_of"]
