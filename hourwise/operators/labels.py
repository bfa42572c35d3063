"""High-demand labels: a value above the quantile of comparable fitting rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.operators.audit import lookup_or_fail
from hourwise.operators.quantiles import grouped_quantiles


def fit_thresholds(df: DataFrame, keys: Sequence[str], value: str, share: float) -> DataFrame:
    """[keys, threshold, n]; no keys gives one global row."""
    return grouped_quantiles(df, keys, value, {"threshold": share}).select(*keys, "threshold", "n")


def apply_thresholds(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str, name: str = "label") -> DataFrame:
    """Add 0/1 `name`: strictly above the threshold of the row's cell. A row without a cell fails the job."""
    if keys:
        joined = lookup_or_fail(df, table, keys, "threshold")
    else:
        joined = df.withColumn("threshold", F.lit(table.first()["threshold"]))
    return joined.withColumn(name, (F.col(value) > F.col("threshold")).cast("int")).drop("threshold")


def describe_rule(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n_cells"), F.min("n").alias("min_cell_n"))
