"""Group statistics: summaries, profiles, residual tables and variance shares.

Everything is a sum, so it combines inside each task before a shuffle; wide sums are turned into means afterwards."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.operators.audit import lookup
from hourwise.operators.quantiles import grouped_quantiles
from hourwise.operators.ranks import running_totals


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def adjusted_skewness(c: Column | str) -> Column:
    """Sample skewness with the small-sample factor (the built-in is the population form)."""
    n = F.count(_c(c)).cast("double")
    return F.skewness(_c(c)) * F.sqrt(n * (n - 1)) / (n - 2)


def numeric_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """mean, sd, adjusted skew, min, max and exact median, q75, q90, q99."""
    quant = grouped_quantiles(df, keys, value, {"median": 0.5, "q75": 0.75, "q90": 0.9, "q99": 0.99})
    stats = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                  adjusted_skewness(value).alias("skew"), F.min(value).alias("min"), F.max(value).alias("max"))
    return stats.join(quant, list(keys)) if keys else stats.withColumn("_k", F.lit(1)).join(
        quant.withColumn("_k", F.lit(1)), "_k").drop("_k")


def table_profile(df: DataFrame, day: str, columns: Sequence[str]) -> DataFrame:
    """Rows, distinct days, day-of-month set, range and nulls. Days are reduced first, so the distinct set is tiny."""
    nulls = None
    for c in columns:
        one = F.col(c).isNull().cast("bigint")
        nulls = one if nulls is None else nulls + one
    per_day = df.groupBy(F.col(day).alias("d")).agg(F.count("*").alias("n"), F.sum(nulls).alias("nulls"))
    return per_day.agg(F.sum("n").alias("n_rows"), F.count("d").alias("n_days"), F.min("d").alias("first_day"),
                       F.max("d").alias("last_day"), F.sum("nulls").alias("n_null"),
                       F.array_join(F.sort_array(F.collect_set(F.dayofmonth("d"))), ",").alias("days_of_month"))


def mean_pivot(df: DataFrame, row: str, column: str, levels: Sequence, value: str, prefix: str) -> DataFrame:
    """Mean of `value`, `row` down and the listed levels across (no extra job to find the levels)."""
    wide = df.groupBy(row).pivot(column, list(levels)).agg(F.avg(value))
    return wide.withColumnsRenamed({str(k): f"{prefix}{k}" for k in levels})


def cell_noise_floor(df: DataFrame, cells: Sequence[Column | str], value: str) -> DataFrame:
    """Share of variance the cell means explain, plain and adjusted for degrees of freedom, with singleton shares.

    Within-cell and total sums of squares come from per-cell variance moments, not from differences of large sums."""
    v = F.col(value).cast("double")
    per_cell = df.groupBy(*cells).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("v"))
    n = F.sum("n").cast("double")
    within = F.sum(F.col("v") * F.col("n"))
    grand = F.sum(F.col("m") * F.col("n")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    k = F.count("*").cast("double")
    single = F.sum((F.col("n") == 1).cast("double"))
    out = per_cell.agg(n.alias("n"), k.alias("k"), within.alias("w"), (within + between).alias("t"), single.alias("s"))
    return out.select((1 - F.col("w") / F.col("t")).alias("r2"),
                      F.when(F.col("n") == F.col("k"), 0.0).otherwise(
                          1 - (F.col("w") / (F.col("n") - F.col("k"))) / (F.col("t") / (F.col("n") - 1))).alias("r2_adjusted"),
                      F.col("k").cast("bigint").alias("n_cells"), (F.col("s") / F.col("k")).alias("singleton_cell_share"),
                      (F.col("s") / F.col("n")).alias("singleton_row_share"))


def mean_variance_law(df: DataFrame, cells: Sequence[str], value: str, min_n: int) -> DataFrame:
    """Slope of log variance on log mean over cells with enough rows, and the power it implies."""
    v = F.col(value).cast("double")
    per_cell = (df.groupBy(*cells).agg(F.count("*").alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v"))
                .where((F.col("n") >= min_n) & (F.col("v") > 0) & (F.col("m") > 0)))
    b = F.regr_slope(F.log("v"), F.log("m"))
    return per_cell.agg(b.alias("slope"), (1 - b / 2).alias("implied_power"), F.count("*").alias("n_cells"))


def simple_line(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of one regressor, with the largest absolute residual (second pass over the rows)."""
    line = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    if keys:
        joined = lookup(df, line, keys, "inner")
    else:
        one = line.first()
        joined = df.withColumns({"slope": F.lit(one["slope"]), "intercept": F.lit(one["intercept"])})
    gap = F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))
    return joined.groupBy(*keys).agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
                                     F.max(gap).alias("max_abs_resid"))


def residual_table(df: DataFrame, keys: Sequence[str], y: str, e: str, le: str) -> DataFrame:
    """Per group: rows and their share, mean label, bias, RMSE, share of squared error, log bias and log RMSE."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(y).alias("mean_y"), F.avg(e).alias("bias"),
                              F.sum(F.col(e) * F.col(e)).alias("_sse"), F.avg(le).alias("log_bias"),
                              F.sqrt(F.avg(F.col(le) * F.col(le))).alias("log_rmse"))
    everything = Window.partitionBy(F.lit(0))          # one row per group by now
    return g.select(*keys, "n", (F.col("n") / F.sum("n").over(everything)).alias("row_share"), "mean_y", "bias",
                    F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"),
                    (F.col("_sse") / F.sum("_sse").over(everything)).alias("sse_share"), "log_bias", "log_rmse")


def top_share(df: DataFrame, value: Column, share: float) -> DataFrame:
    """Share of the total of a non-negative value held by its largest rows (exactly ceil(n * share) of them)."""
    hist = df.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    t = running_totals(hist.withColumn("s", F.col("v") * F.col("n")), "v", ["n", "s"], descending=True)
    totals = hist.agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s")).first()
    k = -(-int(totals["n"]) * share // 1)
    before = F.col("cum_n") - F.col("n")
    taken = F.least(F.col("n"), F.greatest(F.lit(int(k)) - before, F.lit(0)))
    return t.agg((F.sum(taken * F.col("v")) / F.lit(float(totals["s"]))).alias("share"), F.sum(taken).alias("n_top"))


def group_variance_share(df: DataFrame, group: Sequence[str], value: str, min_rows: int = 1) -> DataFrame:
    """Share of a residual that whole groups have in common: variance form and squared-error form."""
    g = (df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"),
                                F.sum(F.col(value) * F.col(value)).alias("ss")).where(F.col("n") >= min_rows))
    n = F.sum("n")
    grand = F.sum(F.col("n") * F.col("m")) / n
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    return g.agg((between / (between + within)).alias("variance_share"),
                 (F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("ss")).alias("square_share"),
                 n.alias("rows_used"), F.count("*").alias("n_groups"))


def with_group_stats(df: DataFrame, keys: Sequence[str], value: str, median: bool = False) -> DataFrame:
    """Group mean, size and (exact) median on every row by aggregate and measured lookup, so no group is one task."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("g_mean"), F.count("*").alias("g_n"))
    if median:
        stats = stats.join(grouped_quantiles(df, keys, value, {"g_median": 0.5}).drop("n"), list(keys))
    return lookup(df, stats, keys, "inner")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k aggregated rows per group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
