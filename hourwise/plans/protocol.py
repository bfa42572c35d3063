"""Any model under all validators.

A fitter is a function of (fitting rows, rows to predict) that returns the latter with a column `pred`. It is run on every part
of the three validators: the seeded sides, held-out days and the late rows. The predictions are stored once, beside what they
should be, so that scores and paired comparisons of any two fitters read them and fit nothing again."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.operators import metrics
from hourwise.operators.bootstrap import interval, r2_of, row_bootstrap_sums
from hourwise.session import Lease, stored

Fitter = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Part:
    """One fit of a validator: which rows are fitted on and which are predicted."""
    validator: str
    fold: int
    fit: Column
    held: Column


def three_parts(k: int, val: str = "val", late: str = "late", fold: str = "fold") -> list[Part]:
    """Seeded sides, k folds of whole days inside the training side, and the chronological sides."""
    train = F.col(val) == 0
    days = [Part("days", g, train & (F.col(fold) != g), train & (F.col(fold) == g)) for g in range(k)]
    return [Part("seeded", 0, train, F.col(val) == 1), *days, Part("chrono", 0, F.col(late) == 0, F.col(late) == 1)]


def predictions(df: DataFrame, fitters: dict[str, Fitter], parts: Sequence[Part], key: str = "instant", label: str = "cnt") -> Lease:
    """A stored frame (fitter, validator, fold, key, y, pred) with every part's predictions of every fitter.

    A fitter that leaves out, repeats or invents rows, or predicts something that is no number, is an error."""
    frames = []
    for name, fitter in fitters.items():
        for p in parts:
            done = fitter(df.where(p.fit), df.where(p.held))
            frames.append(done.select(F.lit(name).alias("fitter"), F.lit(p.validator).alias("validator"), F.lit(p.fold).alias("fold"),
                                      F.col(key).alias("key"), F.col("pred").cast("double").alias("pred")))
    asked = reduce(DataFrame.unionAll, [df.where(p.held).select(F.lit(p.validator).alias("validator"), F.lit(p.fold).alias("fold"), F.col(key).alias("key"),
                                                                F.col(label).cast("double").alias("y")) for p in parts])
    names = F.explode(F.array(*[F.lit(n) for n in fitters])).alias("fitter")
    on = ["fitter", "validator", "fold", "key"]
    given = reduce(DataFrame.unionAll, frames).groupBy(*on).agg(F.max("pred").alias("pred"), F.count("*").alias("times"))
    out = stored(asked.select(names, "*").join(given, on, "full"), "predictions")
    wrong = F.col("y").isNull() | (F.coalesce("times", F.lit(0)) != 1) | F.col("pred").isNull() | F.isnan("pred") | (F.abs("pred") == float("inf"))
    bad = out.frame.where(wrong).groupBy("fitter").count().collect()
    if bad:
        out.release()
        raise ValueError(f"rows without exactly one finite prediction: {dict((r['fitter'], r['count']) for r in bad)}")
    out.frame = out.frame.drop("times")
    return out


def part_scores(predicted: DataFrame) -> DataFrame:
    """(fitter, validator, fold, n, r2, rmse, mean_ratio) of stored predictions."""
    return predicted.groupBy("fitter", "validator", "fold").agg(F.count("*").alias("n"), metrics.r2("y", "pred").alias("r2"), metrics.rmse("y", "pred").alias("rmse"),
                                                                (F.avg("pred") / F.avg("y")).alias("mean_ratio"))


def three_scores(predicted: DataFrame) -> DataFrame:
    """One row per fitter: seeded score, mean and spread over the held-out days, chronological score and mean ratio."""
    def of(validator: str, value: str, agg=F.max):
        return agg(F.when(F.col("validator") == validator, F.col(value)))
    return part_scores(predicted).groupBy("fitter").agg(
        of("seeded", "r2").alias("r2"), of("seeded", "rmse").alias("rmse"), of("days", "r2", F.avg).alias("day_r2"), of("days", "r2", F.stddev_samp).alias("day_sd"),
        of("chrono", "r2").alias("chrono_r2"), of("chrono", "mean_ratio").alias("chrono_mean_ratio"))


def paired(predicted: DataFrame, a: str, b: str, validator: str = "seeded", draws: int = 1000, seed: int = 0) -> DataFrame:
    """R2 of fitter a minus R2 of fitter b on the rows of a validator, with the interval of the same row resamples."""
    rows = predicted.where(F.col("validator") == validator).groupBy("key").agg(
        F.max("y").alias("y"), *[F.max(F.when(F.col("fitter") == n, F.col("pred"))).alias(c) for c, n in (("pa", a), ("pb", b))])
    delta = rows.agg((metrics.r2("y", "pa") - metrics.r2("y", "pb")).alias("delta")).first()["delta"]
    values = r2_of(row_bootstrap_sums(rows, "key", "y", ["pa", "pb"], draws, seed), "pa", "pb")
    return interval(values).select(F.lit(delta).alias("delta"), "lo", "hi", "se")
