"""Result files (O5, O6): histories, weights and run times.

The reference writes headerless text files with one number per line, whose
line number is the index. Reading keeps that index exactly, also over several
files and splits (see ``line_index``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; the index is an explicit column, never the line
    order."""
    df.write.mode(mode).option("header", True).csv(path)


def write_numbers(df: DataFrame, path: str, value: str, order: str,
                  mode: str = "errorifexists") -> None:
    """O5 in the reference's own format: one number per line, in ``order``,
    no header. Result tables are coefficient- or iteration-length, so one
    sorted file is written by one task."""
    (df.repartition(1).sortWithinPartitions(order)
     .select(F.col(value).cast("double").cast("string").alias("v")).write.mode(mode).text(path))


def line_index(df: DataFrame, name: str = "line") -> DataFrame:
    """0-based line number of every row of a freshly read text/CSV source:
    files by path, splits of a file by their first byte. Spark deals splits to
    partitions by size, so neither the partition nor the row id tells the order;
    a split's place comes from its file's metadata, a row's place in it from the
    row id, and the splits' row counts (one row each) are summed up in a window."""
    from pyspark.sql import Window
    split = ["_path", "_from"]
    tagged = df.select("*", F.col("_metadata.file_path").alias("_path"),
                       F.col("_metadata.file_block_start").alias("_from"),
                       F.monotonically_increasing_id().alias("_id"))
    sizes = tagged.groupBy(*split).agg(F.count(F.lit(1)).alias("_held"), F.min("_id").alias("_first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    return (tagged.join(starts.select(*split, "_first", "_before"), split)
            .withColumn(name, (F.col("_before") + F.col("_id") - F.col("_first")).cast("int"))
            .drop("_path", "_from", "_id", "_first", "_before"))


def read_number_file(spark: SparkSession, path: str, value: str = "value",
                     index: str = "iteration", base: int = 1) -> DataFrame:
    """One number per line, no header -> (index, value); index from ``base``."""
    raw = spark.read.schema(T.StructType([T.StructField("_v", T.StringType())])).csv(path)
    out = line_index(raw, "_line")
    return out.select((F.col("_line") + F.lit(base)).cast("int").alias(index),
                      F.trim("_v").cast("double").alias(value))


def read_results(spark: SparkSession, files: Mapping[str, str], value: str = "objective",
                 index: str = "iteration", base: int = 1) -> DataFrame:
    """Several one-column result files -> (method, index, value)."""
    parts = [read_number_file(spark, p, value, index, base)
             .select(F.lit(m).alias("method"), index, value) for m, p in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_wide_times(spark: SparkSession, path: str) -> DataFrame:
    """Wide run-time table with a header of method names and one row per run
    -> (method, run, ns)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    methods = raw.columns
    typed = raw.select(*[F.col(c).cast("double").alias(c) for c in methods])
    typed = line_index(typed, "_run")
    return typed.unpivot([(F.col("_run") + 1).cast("int").alias("run")], methods,
                         "method", "ns")


#: File names of result folders: method, rows and columns of the problem; a folder
#: that Spark wrote holds part files.
RESULT_NAME = r"([A-Za-z_]+)\.csv\.(\d+)-(\d+)(?:/part-[^/]*)?$"


def read_result_folder(spark: SparkSession, folder: str, value: str = "value", index: str = "iteration",
                       base: int = 1, name: str = RESULT_NAME) -> DataFrame:
    """All result files below a folder, one number per line, in one scan ->
    (method, n_rows, n_cols, index, value). Method and size come from the file's path
    (the groups of ``name``; files with other names are left out), the index is the
    line's number in its file: a file's lines are numbered on their own, by the place of
    their split and in it."""
    from pyspark.sql import Window
    path = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", "true").text(folder)
    named = lines.where(path.rlike(name)).select(
        F.trim("value").cast("double").alias(value), path.alias("_path"),
        F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"))
    part = F.regexp_replace("_path", "/part-[^/]*$", "")  # part files of one written table follow each other
    row = F.row_number().over(Window.partitionBy(part).orderBy("_path", "_from", "_id"))
    return named.select(*[F.regexp_extract("_path", name, i + 1).cast(t).alias(c) for i, (c, t) in
                          enumerate((("method", "string"), ("n_rows", "bigint"), ("n_cols", "bigint")))],
                        (row + F.lit(base - 1)).cast("int").alias(index), value)
