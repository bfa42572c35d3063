"""Typed table scans: demand files, the provided star schema and the hourly rollup of raw events."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwise.functions import calendar as cal

# The closed schema of a demand table: anything else in a file is an error, nothing is inferred.
DEMAND_SCHEMA = T.StructType([
    T.StructField("instant", T.LongType()), T.StructField("dteday", T.DateType()),
    T.StructField("season", T.IntegerType()), T.StructField("yr", T.IntegerType()),
    T.StructField("mnth", T.IntegerType()), T.StructField("hr", T.IntegerType()),
    T.StructField("holiday", T.IntegerType()), T.StructField("weekday", T.IntegerType()),
    T.StructField("workingday", T.IntegerType()), T.StructField("weathersit", T.IntegerType()),
    T.StructField("temp", T.DoubleType()), T.StructField("atemp", T.DoubleType()),
    T.StructField("hum", T.DoubleType()), T.StructField("windspeed", T.DoubleType()),
    T.StructField("cnt", T.LongType())])
LABEL = "cnt"
TIMELINE_COLUMNS = ("dteday", "hr", "weathersit")


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One parquet table of `folder`, pruned to `columns`."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def demand_file(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """A demand table from CSV (header) or parquet with the schema enforced and the hour index attached.

    The scoring table is the same without the label column. A malformed row or a header that does not match the
    schema fails the job instead of turning into nulls."""
    schema = T.StructType([f for f in DEMAND_SCHEMA.fields if labelled or f.name != LABEL])
    if path.endswith(".parquet"):
        found = spark.read.parquet(path)
        unknown = set(found.columns) ^ set(schema.fieldNames())
        if unknown:
            raise ValueError(f"columns differ from the demand schema: {sorted(unknown)}")
        df = found.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    else:
        df = (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
              .option("mode", "FAILFAST").csv(path))
    return df.withColumn("hour_idx", cal.hour_index("dteday", "hr"))


def timeline_scan(df: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] = TIMELINE_COLUMNS) -> DataFrame:
    """Only the columns a weather lookup may read: the label is pruned from the scan itself."""
    return df.select(*keys, *columns)


def joint_timeline(labelled: DataFrame, scoring: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Label-free timeline of both tables; the labelled file comes first when an hour is in both."""
    first = timeline_scan(labelled, keys).withColumn("origin", F.lit(0))
    second = timeline_scan(scoring, keys).withColumn("origin", F.lit(1))
    return first.unionByName(second)


def hourly_rollup(events: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Raw events to one row per key and hour: an hour without events is an absent row, not a zero.

    Only algebraic aggregates are meant here, so each task combines before the shuffle and one hot key costs no
    more than one row per hour and task."""
    day = F.to_date(ts)
    return (events.select("*", day.alias("dteday"), F.hour(ts).alias("hr"))
            .groupBy(*keys, "dteday", "hr").agg(*[c.alias(n) for n, c in aggregates.items()])
            .withColumn("hour_idx", cal.hour_index("dteday", "hr")))
