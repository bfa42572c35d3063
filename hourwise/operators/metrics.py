"""Regression and classification metrics as one aggregate, or as sums over distinct scores."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.functions.calendar import closed_last_bin
from hourwise.operators.quantiles import quantile_bins
from hourwise.operators.ranks import cumulative_counts, running_totals


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r2(y: Column | str, p: Column | str) -> Column:
    """1 - SSE / SST around the mean of the rows evaluated."""
    e = _c(y) - _c(p)
    return 1 - F.sum(e * e) / (F.var_pop(_c(y)) * F.count(_c(y)))


def rmse(y: Column | str, p: Column | str) -> Column:
    e = _c(y) - _c(p)
    return F.sqrt(F.avg(e * e))


def operator_costs(y: Column | str, p: Column | str, k: float) -> dict[str, Column]:
    """Costs when an under-prediction is k times as expensive: squared, absolute, share under, mean error."""
    r = _c(p) - _c(y)
    weight = F.when(r < 0, float(k)).otherwise(1.0)
    return {"sq_cost": F.avg(weight * r * r), "abs_cost": F.avg(weight * F.abs(r)),
            "under_share": F.avg((r < 0).cast("double")), "mean_error": F.avg(r)}


def log_loss(y: Column | str, eta: Column | str) -> Column:
    """Mean cross-entropy of a linear score, without overflow."""
    eta, y = _c(eta), _c(y)
    softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    return F.avg(softplus - y * eta)


def confusion(y: Column | str, p: Column | str, threshold: float) -> dict[str, Column]:
    hit, pos = _c(p) >= threshold, _c(y) == 1

    def n(c):
        return F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return {"tp": n(hit & pos), "fp": n(hit & ~pos), "tn": n(~hit & ~pos), "fn": n(~hit & pos)}


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def with_rates(df: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from tp, fp, tn, fn; 0 when a denominator is 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = df.withColumns({"accuracy": _safe(tp + tn, tp + fp + tn + fn), "precision": _safe(tp, tp + fp),
                          "recall": _safe(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", _safe(2 * p * r, p + r))


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds: Sequence[float], cost_ratio: float) -> DataFrame:
    """Confusion, rates and cost at every threshold: rows are counted per interval between thresholds once."""
    cuts = sorted(thresholds)
    above = F.lit(0)
    for i, t in enumerate(cuts, start=1):
        above = F.when(F.col(p) >= t, F.lit(i)).otherwise(above)
    counts = df.groupBy(above.alias("_i")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"),
                                               F.sum((F.col(y) != 1).cast("bigint")).alias("neg"))
    grid = df.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(cuts, start=1)] + [(0, None)], "_i int, thr double")
    filled = grid.join(counts, "_i", "left").fillna(0, ["pos", "neg"])
    up = Window.orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)   # one row per threshold
    whole = Window.partitionBy(F.lit(0))
    table = filled.select("_i", "thr", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"),
                          F.sum("pos").over(whole).alias("_p"), F.sum("neg").over(whole).alias("_n")).where("_i > 0")
    table = table.select("thr", "tp", "fp", (F.col("_n") - F.col("fp")).alias("tn"), (F.col("_p") - F.col("tp")).alias("fn"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return with_rates(table).withColumn("cost", (F.col("fn") * float(cost_ratio) + F.col("fp")) / n)


def best_thresholds(sweep: DataFrame) -> DataFrame:
    """Threshold with the best F1 and the lowest cost; ties take the lowest threshold."""
    return sweep.agg(F.max_by("thr", F.struct("f1", -F.col("thr"))).alias("best_f1"),
                     F.min_by("thr", F.struct("cost", "thr")).alias("best_cost"))


def roc_auc(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney form: a tie counts half. One row (per `keys`): auc, n_pos, n_neg."""
    c = cumulative_counts(df, p, y, keys)
    n1, n0 = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return c.groupBy(*keys).agg((wins / (n1.cast("double") * n0)).alias("auc"), n1.alias("n_pos"), n0.alias("n_neg"))


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    """Sum of recall steps times precision over distinct scores."""
    c = cumulative_counts(df, p, y)
    return c.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("pr_auc"))


def curve_points(df: DataFrame, y: str, p: str, points: int) -> DataFrame:
    """About `points` ROC and PR points at evenly spread positions of the descending order.

    A position inside a run of equal scores gives the point at the end of the run."""
    hist = df.groupBy(p).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"),
                             F.sum((F.col(y) != 1).cast("bigint")).alias("neg"), F.count("*").alias("n"))
    c = running_totals(hist, p, ["pos", "neg", "n"], descending=True)
    total = hist.agg(F.sum("n").alias("n"), F.sum("pos").alias("p"), F.sum("neg").alias("q")).first()
    start, stop = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    span, steps = max(int(total["n"]) - 1, 1), points - 1
    i = F.expr(f"((cum_n - n) * {steps} + {span} - 1) div {span}")
    keep = (i <= steps) & (F.floor(i * span / F.lit(steps)) <= stop) & (start >= 0)
    return c.where(keep).select(F.col(p).alias("thr"), (F.col("cum_neg") / total["q"]).alias("fpr"),
                                (F.col("cum_pos") / total["p"]).alias("recall"),
                                (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width bins on [0, 1], the last closed: n, mean score, share positive; every bin has a row."""
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    got = df.groupBy(closed_last_bin(p, edges).alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("frac_pos"))
    grid = df.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, lo double, hi double")
    return grid.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def largest_calibration_gap(table: DataFrame, min_n: int) -> DataFrame:
    gap = F.max(F.when(F.col("n") >= min_n, F.abs(F.col("mean_p") - F.col("frac_pos"))))
    return table.agg(gap.alias("max_gap"))


def heteroscedasticity(df: DataFrame, e: str, p: str) -> DataFrame:
    """Correlation of |error| with the prediction and the error spread in the lowest and highest decile of it."""
    binned = quantile_bins(df, p, 10, "_decile")
    top = binned.agg(F.max("_decile")).first()[0]
    return binned.agg(F.corr(F.abs(F.col(e)), F.col(p)).alias("corr"),
                      F.stddev_samp(F.when(F.col("_decile") == 0, F.col(e))).alias("sd_low"),
                      F.stddev_samp(F.when(F.col("_decile") == top, F.col(e))).alias("sd_high"))


def back_transform_table(df: DataFrame, target_power: float, factors: dict[str, float], y: str, eta: str) -> DataFrame:
    """R2, RMSE, mean ratio and clipped rows of every factor, all in one pass over the rows."""
    from hourwise.functions.target import PowerTarget
    t = PowerTarget(target_power, "none")
    aggs = []
    for name, s in factors.items():
        p = t.counts(eta, s)
        aggs.append(F.struct(F.lit(name).alias("method"), F.lit(float(s)).alias("factor"), r2(y, p).alias("r2"), rmse(y, p).alias("rmse"),
                             (F.avg(p) / F.avg(F.col(y))).alias("mean_ratio"),
                             F.sum((t.unclipped(eta, s) < 0).cast("bigint")).alias("n_clipped")))
    return df.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))
