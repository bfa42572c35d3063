"""Batch scoring with stored weights and the plausibility checks of its output."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourwise.functions.target import PowerTarget, linear_score
from hourwise.operators.audit import cell_ratio
from hourwise.plans.design import Design
from hourwise.plans.spec import DesignSpec

# The band of plausible ratios.
BAND = (0.4, 2.5)


def score_rows(df: DataFrame, design: Design, weights: dict[str, float], intercept: float, target: PowerTarget, factor: float,
               cap: float, out: str = "pred") -> DataFrame:
    """One select: stored statistics, linear score, cap, back-transform, clip. The model is a set of literals, so the
    rows need no join and no shuffle, and a stream of rows can be scored the same way."""
    columns = design.columns(list(weights))
    z = df.withColumns({f"_z{i}": c for i, c in enumerate(columns.values())})
    eta = linear_score({f"_z{i}": weights[n] for i, n in enumerate(columns)}, intercept)
    return z.withColumn(out, target.counts(target.capped(eta, cap), factor)).drop(*[f"_z{i}" for i in range(len(columns))])


MODEL_SCHEMA = "part string, name string, a double, b double"


def store_model(spark: SparkSession, path: str, design: Design, weights: dict[str, float], intercept: float, target: PowerTarget, factor: float, cap: float) -> None:
    """Everything that scoring needs as one small table: plan, statistics, humidity fill, weights, cap and factor."""
    numbers = {"intercept": intercept, "factor": factor, "cap": cap, "power": target.power, "hum_fill": design.fill}
    rows = [("plan", json.dumps(design.spec.to_dict()), None, None), ("epoch", design.epoch, None, None), ("back", target.back, None, None)]
    rows += [("number", n, float(v), None) for n, v in numbers.items()]
    rows += [("statistic", n, design.mean[n], design.std[n]) for n in design.spec.names[1:]]
    rows += [("weight", n, float(w), None) for n, w in weights.items()]
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.parquet(path)


def score_stored(df: DataFrame, path: str, out: str = "pred") -> DataFrame:
    """`df` scored by a stored model in one select. A plan with user columns of its own needs `score_rows`."""
    parts: dict[str, dict] = {}
    for r in df.sparkSession.read.schema(MODEL_SCHEMA).parquet(path).collect():      # a row per feature
        parts.setdefault(r["part"], {})[r["name"]] = (r["a"], r["b"])
    number = {n: a for n, (a, _) in parts["number"].items()}
    design = Design(DesignSpec.from_dict(json.loads(*parts["plan"])), *parts["epoch"], fill=number["hum_fill"])
    for n, (mean, std) in parts["statistic"].items():
        design.set_stat(n, mean, std)
    weights = {n: a for n, (a, _) in parts["weight"].items()}
    return score_rows(df, design, weights, number["intercept"], PowerTarget(number["power"], *parts["back"]), number["factor"], number["cap"], out)


def outside_band(ratios: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    lo, hi = band
    bad = (F.col("ratio") < lo) | (F.col("ratio") > hi)
    return ratios.agg(F.count("ratio").alias("n_cells"), F.sum(bad.cast("bigint")).alias("n_outside"), F.avg(bad.cast("double")).alias("share_outside"),
                      F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"))


def profile_check(scored: DataFrame, labelled: DataFrame, keys: Sequence[str], pred: str, label: str) -> DataFrame:
    """Mean prediction over mean label per cell, reduced to the share of cells outside the band."""
    return outside_band(cell_ratio(scored, labelled, keys, pred, label))
