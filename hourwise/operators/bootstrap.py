"""Resampling intervals that give the same answer however the rows are partitioned.

Row resampling gives each row a Poisson(1) weight per draw from a hash of (seed, draw, key); group resampling draws
whole groups with replacement and needs only the sums of each group."""
from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.operators.splits import group_draws, numbered_groups, ranked_days

# Multipliers of a published 32-bit integer mixer, and a Weyl step for the draw number.
MIX_A, MIX_B, STEP = 0x7FEB352D, 0x846CA68B, 0x9E3779B9
# Cumulative Poisson(1) probabilities on the 32-bit scale; the weight is the number of entries not above the hash.
STRETCH = 512          # distinct scores whose weights of all draws a task holds at once
POISSON_CUTS = [int(2 ** 32 * sum(exp(-1.0) / factorial(j) for j in range(k + 1))) for k in range(12)]


def _mix(x: np.ndarray) -> np.ndarray:
    m = np.uint64(0xFFFFFFFF)
    x = x ^ (x >> np.uint64(16))
    x = (x * np.uint64(MIX_A)) & m
    x = x ^ (x >> np.uint64(15))
    x = (x * np.uint64(MIX_B)) & m
    return x ^ (x >> np.uint64(16))


def poisson_weights(keys: np.ndarray, seed: int, draws: np.ndarray) -> np.ndarray:
    """(rows, draws) weights of integer keys."""
    return np.searchsorted(np.array(POISSON_CUTS, dtype=np.uint64), _hashed(keys, seed, draws), side="right").astype(np.float64)


def _hashed(keys: np.ndarray, seed: int, draws: np.ndarray) -> np.ndarray:
    """(rows, draws) hashes of 32 bits."""
    k = keys.astype(np.int64).view(np.uint64)
    low, high = k & np.uint64(0xFFFFFFFF), k >> np.uint64(32)
    stream = _mix((np.uint64(seed) + draws.astype(np.uint64) * np.uint64(STEP)) & np.uint64(0xFFFFFFFF))
    return _mix(_mix(low[:, None] ^ stream[None, :]) ^ high[:, None])      # all 64 bits count


def row_bootstrap_sums(df: DataFrame, key: str, y: str, predictions: Sequence[str], draws: int, seed: int) -> DataFrame:
    """One row per draw: weighted n, sum y, sum y^2 and the squared error of each prediction (sse_<name>).

    Each task sends one row per draw, so the shuffle does not grow with the table."""
    names = ["n", "sy", "syy", *[f"sse_{p}" for p in predictions]]
    numbers = np.arange(draws)

    def partial(batches):
        total = np.zeros((draws, len(names)))
        for batch in batches:
            yv = batch.column(y).to_numpy(zero_copy_only=False).astype(float)
            kv = batch.column(key).to_numpy(zero_copy_only=False)
            sums = np.column_stack([np.ones_like(yv), yv, yv * yv, *[
                (yv - batch.column(p).to_numpy(zero_copy_only=False)) ** 2 for p in predictions]])
            for lo in range(0, draws, 128):                     # bounds the weight block to rows x 128
                part = numbers[lo:lo + 128]
                total[lo:lo + 128] += poisson_weights(kv, seed, part).T @ sums
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *[pa.array(total[:, i]) for i in range(len(names))]],
                                         ["b", *names])

    schema = "b int, " + ", ".join(f"`{n}` double" for n in names)
    return (df.select(key, F.col(y).cast("double").alias(y), *predictions).mapInArrow(partial, schema)
            .groupBy("b").agg(*[F.sum(n).alias(n) for n in names]))


def group_bootstrap_sums(df: DataFrame, group: str, y: str, predictions: Sequence[str], draws: int, seed: int) -> DataFrame:
    """Same sums when whole groups (dates) are drawn with replacement: exact from per-group sums."""
    yc = F.col(y).cast("double")
    sums = {"n": F.count("*").cast("double"), "sy": F.sum(yc), "syy": F.sum(yc * yc),
            **{f"sse_{p}": F.sum((yc - F.col(p)) * (yc - F.col(p))) for p in predictions}}
    per_group = df.groupBy(group).agg(*[c.alias(n) for n, c in sums.items()])
    numbered = per_group.join(numbered_groups(df, group), group)
    d = numbered.count()
    drawn = group_draws(d, draws, seed, df.sparkSession)
    return drawn.join(numbered, "group_no").groupBy("b").agg(*[F.sum(F.col("times") * F.col(n)).alias(n) for n in sums])


def subset_sums(df: DataFrame, group: str, y: str, prediction: str, draws: int, m: int, seed: int) -> DataFrame:
    """Sums over m groups drawn without replacement: per draw the m groups with the smallest hash."""
    from pyspark.sql import Window

    from hourwise.operators.ranks import hash32
    yc = F.col(y).cast("double")
    per_group = df.groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum(yc).alias("sy"), F.sum(yc * yc).alias("syy"),
                                      F.sum((yc - F.col(prediction)) * (yc - F.col(prediction))).alias(f"sse_{prediction}"))
    spread = per_group.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    place = F.row_number().over(Window.partitionBy("b").orderBy(hash32(seed, "b", group), group))   # one row per date
    return (spread.withColumn("_place", place).where(F.col("_place") <= m).groupBy("b")
            .agg(*[F.sum(c).alias(c) for c in ("n", "sy", "syy", f"sse_{prediction}")]))


def r2_of(sums: DataFrame, prediction: str, other: str | None = None) -> DataFrame:
    """(b, value): R2 per draw, or the difference of two R2 on the same draw."""
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    one = 1 - F.col(f"sse_{prediction}") / sst
    value = one if other is None else one - (1 - F.col(f"sse_{other}") / sst)
    return sums.select("b", value.alias("value"))


def interval(values: DataFrame) -> DataFrame:
    """Percentile 95 % interval and standard error (one value per draw, so the exact percentile is small)."""
    q = F.percentile("value", [0.025, 0.975])
    return values.agg(q[0].alias("lo"), q[1].alias("hi"), F.stddev_samp("value").alias("se"))


POISSON_BLOCK = 256          # a larger mean is drawn in parts of this size, each with a counter of its own
NORMAL_FROM = 1 << 20        # from this mean on the rounded normal law stands for the Poisson law


def poisson_counts(keys: np.ndarray, means: np.ndarray, seed: int, draws: np.ndarray, all_draws: int) -> np.ndarray:
    """(keys, draws) Poisson numbers with a mean for each key, from counters alone: a key, a draw and a part give one uniform
    number, turned into a count by the inverse of the distribution. `all_draws` is the number of draws of the whole run."""
    def uniform(rows, part):
        return (_hashed(keys[rows], seed, draws + part * all_draws) + 0.5) / 2.0 ** 32

    out = np.zeros((len(keys), len(draws)))
    large = means >= NORMAL_FROM
    if large.any():
        radius = np.sqrt(-2.0 * np.log(uniform(large, 0)))
        z = radius * np.cos(2.0 * np.pi * uniform(large, 1))
        out[large] = np.maximum(0.0, np.rint(means[large, None] + np.sqrt(means[large, None]) * z))
    left, part = np.where(large, 0, means), 0
    while (left > 0).any():
        rows = np.flatnonzero(left > 0)
        mean = np.minimum(left[rows], POISSON_BLOCK).astype(float)[:, None]
        u, k, chance = uniform(rows, part), 0, np.exp(-mean)
        reached = chance.copy()
        while (above := u >= reached).any() and k < mean.max() + 40 * np.sqrt(mean.max()) + 60:
            out[rows] += above
            k += 1
            chance = chance * mean / k
            reached += chance
        left[rows] -= mean[:, 0].astype(left.dtype)
        part += 1
    return out


def auc_bootstrap(df: DataFrame, y: str, p: str, draws: int, seed: int) -> DataFrame:
    """(b, value): ROC-AUC per draw. The n equal scores of a class get a Poisson(n) weight, the sum of n row weights.

    Distinct scores are numbered in order by ranges; class and number are the counter of a weight. Each sorted stretch gives its own
    wins and totals per draw, and the stretches are chained on a table with one row per stretch and draw."""
    from pyspark.sql import Window

    from hourwise.operators.numbering import numbered
    hist = df.groupBy(F.col(p).cast("double").alias("s")).agg(
        F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.sum((F.col(y) != 1).cast("bigint")).alias("neg"))

    def stretches(batches):
        for batch in (b.slice(at, STRETCH) for b in batches for at in range(0, b.num_rows, STRETCH)):
            number, pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("number", "pos", "neg"))
            for lo in range(0, draws, 128):
                part = np.arange(lo, min(lo + 128, draws))
                up = poisson_counts(2 * number + 1, pos, seed, part, draws)
                down = poisson_counts(2 * number, neg, seed, part, draws)
                below = np.cumsum(down, axis=0) - down / 2.0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number[0])), pa.array(part, pa.int32()), pa.array(up.sum(0)), pa.array(down.sum(0)),
                                                  pa.array((up * below).sum(0))], ["first", "b", "pos", "neg", "wins"])

    # the checkpointed rows lie in order, so a stretch of a partition is a stretch of scores
    parts = numbered(hist, [F.col("s")], "number").select("number", "pos", "neg").mapInArrow(stretches, "first bigint, b int, pos double, neg double, wins double")
    before = Window.partitionBy("b").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    linked = parts.withColumn("_neg", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    return linked.groupBy("b").agg((F.sum(F.col("wins") + F.col("pos") * F.col("_neg")) / (F.sum("pos") * F.sum("neg"))).alias("value"))
