"""Leakage-safe splits. Every choice depends on a hash of the key or on the calendar, never on row order."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourwise.operators.numbering import numbered
from hourwise.operators.ranks import hash32, top_by_hash


def seeded_split(df: DataFrame, key: str, seed: int, share: float, exact: bool = True, name: str = "val") -> DataFrame:
    """Add 0/1 `name`. Exact: ceil(n * share) rows with the smallest hash. Otherwise a plain hash threshold, which
    needs no look at the data and also works on a stream of new rows."""
    h = hash32(seed, key)
    held = top_by_hash(df, h, key, math.ceil(df.count() * share)) if exact else h < int(share * 2 ** 32)
    return df.withColumn(name, held.cast("int"))


def day_folds(df: DataFrame, day: str, k: int, name: str = "fold") -> DataFrame:
    """Fold of a row: rank of its date among the distinct dates, modulo k.

    The ranked table has one row per calendar date, so its window and its join side are bounded by the calendar."""
    dates = df.select(day).distinct()
    ranked = dates.withColumn(name, ((F.dense_rank().over(Window.orderBy(day)) - 1) % k).cast("int"))
    return df.join(ranked, day)


def ranked_days(df: DataFrame, day: str, seed: int) -> DataFrame:
    """One row per date: its 1-based place in one seeded order and the number of dates."""
    dates = df.select(day).distinct().withColumn("_h", hash32(seed, day))
    order = Window.orderBy("_h", day)
    return dates.select(day, F.row_number().over(order).alias("place"),
                        F.count("*").over(Window.partitionBy(F.lit(0))).alias("n_dates"))


def nested_day_subsets(df: DataFrame, day: str, fractions: Sequence[float], seed: int) -> DataFrame:
    """(rows of df) x (subsets that hold their date): `subset` numbers the fractions, each a prefix of ONE order.

    A row is repeated only for the subsets it belongs to."""
    days = ranked_days(df, day, seed)
    wanted = F.array(*[F.struct(F.lit(i).alias("subset"), F.greatest(F.bround(F.col("n_dates") * float(f)), F.lit(1))
                                .cast("int").alias("n_days")) for i, f in enumerate(fractions)])
    member = days.select(day, "place", F.explode(wanted).alias("s")).select(day, "place", "s.*").where("place <= n_days")
    return df.join(member.drop("place"), day)


def group_draws(n_groups: int, draws: int, seed: int, spark) -> DataFrame:
    """(b, group_no, times): how often each of n groups is drawn in each of `draws` resamples with replacement."""
    slots = spark.range(draws * n_groups).select(F.floor(F.col("id") / n_groups).cast("int").alias("b"),
                                                 (F.col("id") % n_groups).alias("slot"))
    pick = (hash32(seed, "b", "slot") % n_groups).cast("int")
    return slots.groupBy("b", pick.alias("group_no")).agg(F.count("*").cast("int").alias("times"))


def numbered_groups(df: DataFrame, group: str) -> DataFrame:
    """One row per distinct group, however many, with a 0-based number in group order."""
    return numbered(df.select(group).distinct(), [F.col(group)], "group_no").withColumn("group_no", F.col("group_no") - 1)
