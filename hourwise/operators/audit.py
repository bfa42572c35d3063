"""Data-quality checks, filters with counts, key joins and set operations."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwise.session import cut_lineage


def date_cut(df: DataFrame, day: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """(rows strictly before the date, rows on or after it); both filters reach the scan."""
    at = F.lit(cut).cast("date")
    return df.where(F.col(day) < at), df.where(F.col(day) >= at)


def condition_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One pass: how many rows meet each condition."""
    return df.agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in conditions.items()])


def date_rule_violations(df: DataFrame, day: str, base_year: int) -> DataFrame:
    """Rows whose stored calendar columns differ from what the date says."""
    weekday = F.dayofweek(day) - 1
    rule = F.col("weekday").between(1, 5) & (F.col("holiday") == 0)
    return condition_counts(df, {
        "weekday_bad": F.col("weekday") != weekday, "yr_bad": F.col("yr") != F.year(day) - base_year,
        "mnth_bad": F.col("mnth") != F.month(day),
        "season_bad": F.col("season") != F.floor((F.col("mnth") - 1) / 3) + 1,
        "workingday_bad": F.col("workingday") != rule.cast("int"),
        "holiday_on_weekend": (F.col("holiday") == 1) & ~F.col("weekday").between(1, 5)})


def output_contract(expected: DataFrame, given: DataFrame, key: str, value: str) -> DataFrame:
    """One row of checks of a prediction table against the table it should answer."""
    left = expected.groupBy(key).agg(F.count("*").alias("_e"))
    right = given.groupBy(key).agg(F.count("*").alias("_g"), F.sum(value).alias("_sum"), F.max(F.abs(F.col(value))).alias("_top"),
                                   F.sum((F.col(value) < 0).cast("bigint")).alias("_neg"),
                                   F.sum((F.isnan(value) | F.col(value).isNull() |
                                          (F.abs(F.col(value)) == float("inf"))).cast("bigint")).alias("_bad"))
    both = left.join(right, key, "full_outer")
    n, m = F.coalesce(F.sum("_e"), F.lit(0)), F.coalesce(F.sum("_g"), F.lit(0))
    return both.agg(n.alias("n_expected"), m.alias("n_given"),
                    F.sum(F.col("_g").isNull().cast("bigint")).alias("n_missing"),
                    F.sum(F.col("_e").isNull().cast("bigint")).alias("n_unknown"),
                    F.sum((F.coalesce("_g", F.lit(0)) > 1).cast("bigint")).alias("n_repeated"),
                    F.coalesce(F.sum("_neg"), F.lit(0)).alias("n_negative"),
                    F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_not_finite"),
                    (F.max("_top") == 0).alias("all_zero"))


SMALL_TABLE = 100_000        # rows of a table that is sent to all executors


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", small: int = SMALL_TABLE) -> DataFrame:
    """`df` joined to a table with one row per key, whatever share of the rows one key holds.

    The table is counted first. Up to `small` rows it is sent to the executors and the rows stay where they are. A larger one is
    joined in two parts: rows of keys with more than a quarter of an even task's share, of which there are at most four
    a task, look in the few table rows of those keys, which are sent; all others are joined by key."""
    keys = list(keys)
    if table.limit(small + 1).count() <= small:
        return df.join(F.broadcast(table), keys, how)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
    total = df.count()
    hot = F.broadcast(cut_lineage(counts.where(F.col("_n") * 4 * tasks > total).select(*keys)))
    few, rest = df.join(hot, keys, "left_semi"), df.join(hot, keys, "left_anti")
    return few.join(F.broadcast(table.join(hot, keys, "left_semi")), keys, how).unionByName(rest.join(table, keys, how))


def lookup_or_fail(df: DataFrame, table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Left join whose value must be found: a row without a cell fails the job."""
    found = lookup(df, table.select(*keys, value), keys)
    kind = table.schema[value].dataType
    checked = F.when(F.col(value).isNull(), F.raise_error(F.lit(f"no cell for this row in the {value} table")).cast(kind)
                     ).otherwise(F.col(value))
    return found.withColumn(value, checked)


def missing_cells(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells of `df` that the table does not hold."""
    return df.select(*keys).distinct().join(table, list(keys), "left_anti")


def cell_ratio(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean of `a` over mean of `b` per cell; cells on one side only are dropped."""
    x = left.groupBy(*keys).agg(F.avg(a).alias("mean_a"))
    y = right.groupBy(*keys).agg(F.avg(b).alias("mean_b"))
    return x.join(y, list(keys)).withColumn("ratio", F.col("mean_a") / F.col("mean_b"))


def lift_by_name(small: DataFrame, names: DataFrame) -> DataFrame:
    """Weights of a small model in the rows of a longer name list, 0 elsewhere; a name without a row is an error."""
    joined = names.join(small, "name", "full_outer")
    weight = F.when(F.col("pos").isNull(), F.raise_error(F.lit("a weight has no place in the name list")).cast(T.DoubleType())
                    ).otherwise(F.coalesce("weight", F.lit(0.0)))
    return joined.select("pos", "name", weight.alias("weight"))


def difference_or_fail(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Required keys, after checking that every one is present."""
    flag = present.select(key).distinct().withColumn("_here", F.lit(True))
    j = required.join(flag, key, "left")
    return j.select(F.when(F.col("_here").isNull(), F.raise_error(F.concat(F.lit("missing: "), F.col(key).cast("string"))))
                    .otherwise(F.col(key)).alias(key))


def flag_in(df: DataFrame, other: DataFrame, keys: dict[str, Column], name: str) -> DataFrame:
    """`df` with 0/1 `name`: whether the given key expressions occur in `other` (whose columns have the same names)."""
    tags = list(keys)
    seen = other.select(*tags).distinct().select(*[F.col(t).alias(f"_k_{t}") for t in tags], F.lit(1).alias("_hit"))
    cond = None
    for t, expr in keys.items():
        one = expr == F.col(f"_k_{t}")
        cond = one if cond is None else cond & one
    return df.join(seen, cond, "left").select(*df.columns, F.coalesce("_hit", F.lit(0)).alias(name))
