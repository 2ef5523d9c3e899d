"""The design table and its storage.

Dense layout: ``row_id BIGINT, label DOUBLE, features ARRAY<DOUBLE>``; rows
carry their key, so nothing depends on row position (the reference pairs
RDDs by position). Cell layout: ``row_id, col_id, value`` plus a label table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESIGN_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType(), True),
    T.StructField("label", T.DoubleType(), True),
    T.StructField("features", T.ArrayType(T.DoubleType(), True), True),
])

PARAM_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("value", T.DoubleType(), False),
])


@dataclass(frozen=True)
class DesignInfo:
    n: int
    p: int


def _bad(v):
    return v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))


def validate_design(df: DataFrame, label: str = "label", features: str = "features") -> DesignInfo:
    """One aggregate pass: row count, feature length, bad values.

    Errors: no rows, unequal feature lengths, null / NaN / infinite label or
    feature. Run on a persisted design, this pass also fills the cache.
    """
    r = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size(features)).alias("pmin"),
        F.max(F.size(features)).alias("pmax"),
        F.sum(F.when(_bad(F.col(label)), 1).otherwise(0)).alias("bad_label"),
        F.sum(F.when(F.col(features).isNull() | F.exists(features, _bad), 1).otherwise(0))
         .alias("bad_features"),
    ).first()
    if r["n"] == 0:
        raise ValueError("design has no rows")
    if r["bad_label"]:
        raise ValueError(f"{r['bad_label']} rows have a null, NaN or infinite label")
    if r["bad_features"]:
        raise ValueError(f"{r['bad_features']} rows have null, NaN or infinite features")
    if r["pmin"] != r["pmax"]:
        raise ValueError(f"unequal feature lengths: {r['pmin']} to {r['pmax']}")
    if r["pmin"] < 1:
        raise ValueError("design has no features")
    return DesignInfo(int(r["n"]), int(r["pmin"]))


def design_from_columns(df: DataFrame, label: str, features: Sequence[str],
                        key: str | None = None) -> DataFrame:
    """Labelled design from scalar columns: features cast to DOUBLE and packed
    into one array, in the given order (column i of the design = features[i]), whose
    width is noted in the schema (``known_width``)."""
    rid = F.col(key).cast("bigint") if key else F.lit(None).cast("bigint")
    return df.select(rid.alias("row_id"), F.col(label).cast("double").alias("label"),
                     F.array(*[F.col(c).cast("double") for c in features])
                     .alias("features", metadata={WIDTH: len(features)}))


#: Key of the feature column's metadata that holds the number of features.
WIDTH = "penfit.width"
#: Designs of at most so many known columns are summed by SQL aggregates: their code stays
#: small (a Gram pass has 46 sums at this width), and moving a row to Python costs more.
NARROW = 8


def known_width(design: DataFrame, features: str = "features") -> int | None:
    """Width noted in the schema by whoever made the feature column, None if there is
    none. No job runs; who relies on it checks every row."""
    return design.schema[features].metadata.get(WIDTH)


def select_label(design: DataFrame) -> DataFrame:
    """(row_id, label) (O13); Catalyst prunes the feature column from the scan."""
    return design.select("row_id", "label")


def select_features(design: DataFrame) -> DataFrame:
    return design.select("row_id", "features")


def to_cells(design: DataFrame, keep_zeros: bool = False) -> tuple[DataFrame, DataFrame]:
    """Dense -> cell layout: (row_id, col_id, value) and (row_id, label).
    Zeros are dropped unless asked for; rows without cells keep their label.
    A null array, and a null, NaN or infinite value, is an error of the job
    that reads the cells, never a dropped cell."""
    bad_row = F.raise_error(F.lit("design row with a null feature array"))
    bad_cell = F.raise_error(F.lit("design cell with a null, NaN or infinite value"))
    whole = F.when(F.col("features").isNull(), bad_row.cast("array<double>")).otherwise(F.col("features"))
    cells = design.select("row_id", F.posexplode(whole).alias("col_id", "value"))
    cells = cells.select("row_id", F.col("col_id").cast("int").alias("col_id"),
                         F.when(_bad(F.col("value")), bad_cell.cast("double"))
                         .otherwise(F.col("value")).alias("value"))
    if not keep_zeros:
        cells = cells.where(F.col("value") != 0.0)
    return cells, design.select("row_id", "label")


def validate_cells(cells: DataFrame, labels: DataFrame, p: int | None = None) -> DesignInfo:
    """Rows and columns of a cell design. Errors: no rows, null keys, repeated
    row_id of a label, repeated (row_id, col_id), null / NaN / infinite value or
    label, col_id outside [0, p), cells whose row has no label."""
    r = labels.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("k"),
                   F.count_if(_bad(F.col("label"))).alias("bad")).first()
    if r["n"] == 0:
        raise ValueError("design has no rows")
    if r["n"] != r["k"]:
        raise ValueError("row_id of the label table is null or not unique")
    if r["bad"]:
        raise ValueError(f"{r['bad']} rows have a null, NaN or infinite label")
    # one shuffle by row_id serves the repeats and the missing labels
    per = cells.groupBy("row_id", "col_id").agg(
        F.count(F.lit(1)).alias("held"), F.count_if(_bad(F.col("value"))).alias("bad"))
    c = per.agg(F.max("col_id").alias("hi"), F.min("col_id").alias("lo"), F.sum("bad").alias("bad"),
                F.count_if(F.col("held") > 1).alias("twice"),
                F.count_if(F.col("row_id").isNull() | F.col("col_id").isNull()).alias("no_key")).first()
    if c["no_key"]:
        raise ValueError("cells with a null row_id or col_id")
    if c["bad"]:
        raise ValueError(f"{c['bad']} cells have a null, NaN or infinite value")
    if c["twice"]:
        raise ValueError(f"{c['twice']} cells (row_id, col_id) are given more than once")
    if c["lo"] is not None and c["lo"] < 0:
        raise ValueError("negative col_id")
    size = p if p is not None else (c["hi"] + 1 if c["hi"] is not None else 0)
    if c["hi"] is not None and c["hi"] >= size:
        raise ValueError(f"col_id {c['hi']} is outside [0, {size})")
    orphans = cells.join(labels, "row_id", "left_anti").count()
    if orphans:
        raise ValueError(f"{orphans} cells belong to rows without a label")
    return DesignInfo(int(r["n"]), int(size))


def align(a: DataFrame, b: DataFrame, on: str | Sequence[str] = "row_id") -> DataFrame:
    """Key join replacing the reference's positional zip (J1). Both sides must
    have unique keys; raises when a key is null, is given twice on a side or has
    no partner, so a, b and the result have equal counts."""
    keys = [on] if isinstance(on, str) else list(on)
    per_key = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))).groupBy(*keys).agg(
        F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    r = per_key.agg(F.count_if(null_key).alias("nulls"), F.count_if(F.col("_a") > 1).alias("da"),
                    F.count_if(F.col("_b") > 1).alias("db"), F.count_if(F.col("_a") == 0).alias("ma"),
                    F.count_if(F.col("_b") == 0).alias("mb")).first()
    if r["nulls"]:
        raise ValueError("align: null key")
    if r["da"] or r["db"]:
        raise ValueError(f"align: {r['da']} keys of the left and {r['db']} of the right side repeat")
    if r["ma"] or r["mb"]:
        raise ValueError(f"align: {r['mb']} rows of the left and {r['ma']} of the "
                         "right side have no partner")
    return a.join(b, keys, "inner")


def source_positions(df: DataFrame, name: str = "row_id") -> DataFrame:
    """``df``, freshly read from Parquet files, with the position of every row in the
    source: files in the order of their paths, rows in the order of their file. Spark
    knows a row's place in its file; the files' row counts (one row per file) are
    summed up and broadcast, so nothing depends on how splits are dealt to tasks, and
    no row moves: shuffled by path, a file's rows would meet in one task."""
    from pyspark.sql import Window
    tagged = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_row"))
    held = df.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("_held"))
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = held.select("_path", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    return (tagged.join(F.broadcast(starts), "_path").withColumn(name, (F.col("_before") + F.col("_row")).cast("bigint"))
            .drop("_path", "_row", "_before"))


def positions(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Any DataFrame with the position of every row: partitions in their order, rows in
    the order of their partition. The rows are written to the checkpoint folder with
    their places, so that numbers and rows belong to one evaluation; the partitions'
    counts (one row each) are summed up and broadcast, no row moves."""
    from pyspark.sql import Window

    from penfit.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    place = F.monotonically_increasing_id()
    kept = df.select("*", F.shiftright(place, 33).alias("_part"),
                     place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).checkpoint(eager=True)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_held")).select(
        "_part", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def align_positions(a: DataFrame, b: DataFrame, name: str = "row_id") -> DataFrame:
    """J1 without keys: the rows of two tables paired by position, as the reference's zip
    does. Raises unless both have the same number of rows. Columns of both; ``name``
    holds the position."""
    return align(positions(a, name), positions(b, name), name)


def row_count(df: DataFrame) -> int:
    """O22."""
    return df.count()


def peek(df: DataFrame, k: int = 10, order: str = "row_id") -> DataFrame:
    """First k rows by key (O23); deterministic, unlike ``first`` on an RDD."""
    return df.orderBy(order).limit(k)


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """O1: parquet with the declared schema."""
    return spark.read.schema(DESIGN_SCHEMA).parquet(path)


def write_design(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """O2: fails when the path exists, as saving an object file does."""
    df.select("row_id", "label", "features").write.mode(mode).parquet(path)


def _is_missing_path(e: AnalysisException) -> bool:
    cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    c = cond() if cond else None
    return c == "PATH_NOT_FOUND" or (c is None and "Path does not exist" in str(e))


def read_or_generate(spark: SparkSession, path: str, generate: Callable[[], DataFrame],
                     param_path: str | None = None,
                     param: Callable[[], float] | None = None) -> DataFrame:
    """O3: read the design; only a missing path makes it generate, write and
    read back. Any other error is raised."""
    try:
        df = read_design(spark, path)
        df.limit(1).collect()
        return df
    except AnalysisException as e:
        if not _is_missing_path(e):
            raise
    write_design(generate(), path)
    if param_path is not None and param is not None:
        write_param(spark, param_path, "lambda", param())
    return read_design(spark, path)


def write_param(spark: SparkSession, path: str, name: str, value: float,
                mode: str = "errorifexists") -> None:
    """One-row table (name, value)."""
    spark.createDataFrame([(name, float(value))], PARAM_SCHEMA).coalesce(1) \
        .write.mode(mode).parquet(path)


def read_param(spark: SparkSession, path: str, name: str | None = None) -> float:
    df = spark.read.schema(PARAM_SCHEMA).parquet(path)
    if name is not None:
        df = df.where(F.col("name") == name)
    r = df.limit(1).collect()
    if not r:
        raise ValueError(f"no parameter {name!r} in {path}")
    return float(r[0]["value"])
