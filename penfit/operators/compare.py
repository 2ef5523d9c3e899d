"""Comparison of results (O45-O48): weights, loss histories, run times.

Inputs are long tables ``(method, <key>, <value>)``; every comparison is a
join on the key plus an aggregate, grouped by method.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _paired(long: DataFrame, reference: str, on: str, value: str, method: str) -> DataFrame:
    ref = long.where(F.col(method) == reference).select(on, F.col(value).alias("_t"))
    other = long.where(F.col(method) != reference).select(method, on, F.col(value).alias("_s"))
    return other.join(ref, on, "inner")


def relative_difference(long: DataFrame, reference: str, on: str, value: str,
                        method: str = "method") -> DataFrame:
    """Per method, ||t - s|| / ||t|| against the reference method's
    values t, rows matched on ``on``. Output (method, relative_difference)."""
    pairs = _paired(long, reference, on, value, method)
    return pairs.groupBy(method).agg(
        (F.sqrt(F.sum((F.col("_t") - F.col("_s")) ** 2)) / F.sqrt(F.sum(F.col("_t") ** 2)))
        .alias("relative_difference"))


def rmse(long: DataFrame, reference: str, on: str, value: str,
         method: str = "method") -> DataFrame:
    """Per method, sqrt(mean((t - s)^2))."""
    pairs = _paired(long, reference, on, value, method)
    return pairs.groupBy(method).agg(
        F.sqrt(F.avg((F.col("_t") - F.col("_s")) ** 2)).alias("rmse"))


def same_iterations(histories: DataFrame, method: str = "method") -> DataFrame:
    """Do all methods have the same number of history rows?
    Output one row (methods, min_iterations, max_iterations, same)."""
    per = histories.groupBy(method).agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("methods"), F.min("k").alias("min_iterations"),
                   F.max("k").alias("max_iterations"),
                   (F.count_distinct("k") == 1).alias("same"))


def timing_table(times: DataFrame, by=("method",), ns: str = "ns") -> DataFrame:
    """Nanoseconds -> milliseconds; per group runs, min, median, mean."""
    ms = F.col(ns) / F.lit(1e6)
    return times.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.min(ms).alias("min_ms"),
                                  F.median(ms).alias("median_ms"), F.avg(ms).alias("mean_ms"))


def to_wide(times: DataFrame, methods, index: str = "run", method: str = "method",
            value: str = "ns") -> DataFrame:
    """Long (method, run, ns) -> one column per method, one row per run (the
    reference's wide file)."""
    return times.groupBy(index).pivot(method, list(methods)).agg(F.first(value)).orderBy(index)


def to_long(wide: DataFrame, methods, index: str = "run", method: str = "method",
            value: str = "ns") -> DataFrame:
    return wide.unpivot([index], list(methods), method, value)
