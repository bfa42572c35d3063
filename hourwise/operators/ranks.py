"""Order statistics without a global window.

Rows are first counted per distinct value, so a value that holds a third of the table becomes one row. The distinct
values are then cut into buckets at approximate quantiles; each bucket is one window partition, and a table with
one row per bucket supplies the running total of the buckets before it."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.operators.numbering import numbered

BUCKET = "_bucket"


def bucket_cuts(df: DataFrame, value: str, buckets: int | None = None) -> tuple[list[float], int]:
    """(cut points at approximate quantiles, approximate number of distinct values) in one job.

    There are as many buckets as the session has shuffle partitions, so the work spreads as that of any other operator."""
    buckets = buckets or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / buckets for i in range(1, buckets)]
    p = df.select(F.col(value).cast("double").alias("_p"))
    row = p.agg(F.percentile_approx("_p", shares, 20 * buckets).alias("c"), F.approx_count_distinct("_p").alias("d")).first()
    return sorted(set(row["c"] or [])), int(row["d"])


def with_cuts(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """`df` with the ordinal bucket of `value`; the cuts are literals, so a recomputed task gives the same bucket."""
    numeric = df.withColumn("_position", F.col(value).cast("double"))
    edges = [float("-inf"), *(c for c in cuts if math.isfinite(c)), float("inf")]
    if len(edges) < 3:
        return numeric.withColumn(BUCKET, F.lit(0.0)).drop("_position")
    return Bucketizer(splits=edges, inputCol="_position", outputCol=BUCKET).transform(numeric).drop("_position")


def with_bucket(df: DataFrame, value: str, buckets: int | None = None, cuts_from: DataFrame | None = None) -> DataFrame:
    """`df` bucketed at its own approximate quantiles, or at those of a cheaper frame with the same column."""
    return with_cuts(df, value, bucket_cuts(df if cuts_from is None else cuts_from, value, buckets)[0])


def running_totals(hist: DataFrame, value: str, sums: Sequence[str], within: Sequence[str] = (),
                   descending: bool = False, buckets: int | None = None, cuts_from: DataFrame | None = None) -> DataFrame:
    """Add cum_<s> (inclusive running total in value order, per `within`) for each column of `sums`.

    `hist` holds one row per (within, value)."""
    b = with_bucket(hist, value, buckets, cuts_from)
    order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    before = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (b.groupBy(*within, BUCKET).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
               .select(*within, BUCKET, *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}")
                                          for s in sums]))
    inside = (Window.partitionBy(*within, BUCKET)
              .orderBy(F.col(value).desc() if descending else F.col(value).asc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = b.join(offsets, [*within, BUCKET])
    return joined.select(*hist.columns, *[(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums])


def average_ranks(df: DataFrame, score: str) -> DataFrame:
    """One row per distinct score: n and the mean 1-based rank its rows share."""
    hist = df.groupBy(score).agg(F.count("*").alias("n"))
    ranked = running_totals(hist, score, ["n"], cuts_from=df)
    return ranked.select(score, "n", (F.col("cum_n") - F.col("n") / 2 + 0.5).alias("avg_rank"))


def cumulative_counts(df: DataFrame, score: str, label: str, within: Sequence[str] = ()) -> DataFrame:
    """tp and fp when every row at or above the score is called positive; one row per distinct score (per `within`)."""
    hist = df.groupBy(*within, score).agg(F.sum((F.col(label) == 1).cast("bigint")).alias("pos"),
                                 F.sum((F.col(label) != 1).cast("bigint")).alias("neg"))
    return (running_totals(hist, score, ["pos", "neg"], within, descending=True, cuts_from=df)
            .withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp"}))


def equal_count_bins(df: DataFrame, value: str, key: str, bins: int) -> DataFrame:
    """`df` with the 1-based bin of an even split in (value, key) order: the first n mod bins bins are one longer.

    One range shuffle of the rows; a value that many rows share is spread by the key."""
    placed = numbered(df, [F.col(value), F.col(key)], "_place")
    short, longer = divmod(placed.count(), bins)
    split, rank0 = longer * (short + 1), F.col("_place") - 1
    late = F.floor((rank0 - split) / F.lit(max(short, 1))) + longer
    which = F.when(rank0 < split, F.floor(rank0 / F.lit(short + 1))).otherwise(late) + 1
    return placed.withColumn("bin", which.cast("int")).drop("_place")


def bin_summary(binned: DataFrame, value: str, resid: str) -> DataFrame:
    return binned.groupBy("bin").agg(F.min(value).alias("lo"), F.max(value).alias("hi"),
                                     F.avg(resid).alias("mean_resid"), F.count("*").alias("n"))


def top_by_hash(df: DataFrame, hash32: Column, key: str, k: int) -> Column:
    """Predicate for exactly the k rows smallest in (hash32, key), found from two 65,536-row histograms.

    Only rows that share the one hash on the border are ordered by key (about n / 2^32 rows)."""
    hashed = df.select(hash32.alias("h"), F.col(key).alias("_k"))

    def border(counts: DataFrame, part: str, want: int) -> tuple[int, int]:
        w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)   # at most 65,536 rows
        hit = (counts.withColumn("c", F.sum("n").over(w)).where(F.col("c") >= want).orderBy(part)
               .select(part, (F.col("c") - F.col("n")).alias("before")).first())
        return int(hit[0]), want - int(hit[1])

    if k <= 0:
        return F.lit(False)
    high = F.shiftright("h", 16).cast("int")
    hi, rest = border(hashed.groupBy(high.alias("p")).agg(F.count("*").alias("n")), "p", k)
    low = F.pmod(F.col("h"), F.lit(65536)).cast("int")
    lo, rest = border(hashed.where(high == hi).groupBy(low.alias("p")).agg(F.count("*").alias("n")), "p", rest)
    exact = hi * 65536 + lo
    last = hashed.where(F.col("h") == exact).orderBy("_k").select("_k").limit(rest).agg(F.max("_k")).first()[0]
    return (hash32 < exact) | ((hash32 == exact) & (F.col(key) <= F.lit(last)))


def hash32(seed: int | str, *cols: Column | str) -> Column:
    """Unsigned 32-bit number from the md5 of the seed and the columns; any SQL engine gives the same one."""
    text = F.concat_ws("_", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
