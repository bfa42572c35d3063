"""Prediction, metric and model tables written and read back."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREDICTION_DECIMALS = 2


def prediction_rows(scored: DataFrame, key: str, prediction: str, out: str = "cnt") -> DataFrame:
    """Key and value rounded to two decimals, one row per input row."""
    return scored.select(key, F.round(prediction, PREDICTION_DECIMALS).alias(out))


def write_predictions(scored: DataFrame, path: str, key: str, prediction: str, out: str = "cnt",
                      fmt: str = "csv") -> None:
    """Write the prediction rows as a folder of part files, one per task."""
    prediction_rows(scored, key, prediction, out).write.mode("overwrite").option("header", True).format(fmt).save(path)


def finite_only(df: DataFrame) -> DataFrame:
    """`df` with every number checked: a NaN or an infinity in any double column fails the job."""
    out = df
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(field.name)
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            out = out.withColumn(field.name, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(
                F.lit(f"column {field.name} holds NaN or infinity"))).otherwise(c).cast(field.dataType))
    return out


def write_metrics(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a metric or model table; refuses NaN and infinities."""
    finite_only(df).write.mode("overwrite").format(fmt).save(path)


def read_model_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """A stored model or metric table with its schema enforced."""
    return spark.read.schema(schema).format(fmt).load(path)
