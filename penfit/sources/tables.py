"""Designs made from the driver's tables (FIXTURES.md section 4)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penfit.sources.design import design_from_columns, source_positions

# Fixed feature lists of the two table designs.
PRICE_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "p_retailprice", "p_size"]
PRICE_LABEL = "l_extendedprice"


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def price_design(spark: SparkSession, sf_dir: str, row_ids: bool = False) -> DataFrame:
    """Lineitem joined with part on the part key; label l_extendedprice.

    A line without a part is left out, as in the join of the reference tables.
    (l_orderkey, l_linenumber) is not unique: row_id is NULL, which is all that
    aggregates and fits need, or with ``row_ids`` the line's position in lineitem.
    Catalyst prunes both scans to the eight columns used; AQE chooses
    broadcast for part from its measured size, else sort-merge.
    """
    li = load_table(spark, sf_dir, "lineitem")
    if row_ids:
        li = source_positions(li, "_position")
    part = load_table(spark, sf_dir, "part")
    joined = li.join(part, li.l_partkey == part.p_partkey, "inner")
    return design_from_columns(joined, PRICE_LABEL, PRICE_FEATURES, "_position" if row_ids else None)


# Fixed shape of the sparse design: columns per event type.
EVENT_SLOTS = 8


def event_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """D3, a sparse design: one row per user, EVENT_SLOTS columns per event type (types in
    the order of their names; an event's column by its id), a cell is the sum of its
    events' values in thousands; the label is the user's number of events. Cells
    (row_id, col_id, value) and labels (row_id, label)."""
    from pyspark.sql import Window
    e = load_table(spark, sf_dir, "events").where("user_id is not null")
    types = e.where("event_type is not null").select("event_type").distinct()
    place = types.withColumn("place", F.row_number().over(Window.orderBy("event_type")) - 1)  # a row per type
    cells = e.where("value is not null and event_id is not null").join(place, "event_type").groupBy(
        F.col("user_id").alias("row_id"),
        (F.col("place") * EVENT_SLOTS + F.pmod("event_id", F.lit(EVENT_SLOTS))).cast("int").alias("col_id")).agg(
        (F.sum("value") / F.lit(1000.0)).alias("value"))
    labels = e.groupBy(F.col("user_id").alias("row_id")).agg(F.count(F.lit(1)).cast("double").alias("label"))
    return cells, labels


def embedding_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings; label = class id, features = embedding as DOUBLE,
    row_id = vec_id."""
    e = load_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("bigint").alias("row_id"),
                    F.col("label").cast("double").alias("label"),
                    F.col("embedding").cast("array<double>").alias("features"))
