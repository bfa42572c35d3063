"""Exact quantiles with linear interpolation, per group, when a group may hold a third of the table.

The built-in exact percentile keeps every distinct value of a group in one task. Here nothing is sorted or shuffled by value:
a pass counts rows per group and bin of equal width, with the smallest and largest value of each bin, and the bin that holds
a wanted position is the range of the next pass. Such a range starts and ends at values, so every pass splits it; it is done
when its ends are equal, after two or three passes on most columns. Counts are combined in the tasks.

Groups come to the driver with their ranges, so there is a bound on them; beyond `MOST_GROUPS` each group is reduced to
(value, count) rows, the counts per bucket say in which bucket a wanted position lies, and only those buckets are ordered."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from hourwise.operators.ranks import BUCKET, bucket_cuts, with_cuts
from hourwise.session import kept

MOST_GROUPS = 5_000
COUNTED = 200_000            # counts that one pass may bring to the driver, over all ranges


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], most_groups: int = MOST_GROUPS) -> DataFrame:
    """One row per group: n and one double column per entry of `quantiles` (name -> share). Nulls are left out."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    with kept(rows) as rows:
        ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).limit(most_groups + 1).collect()
        ends = [r for r in ends if r["n"]]
        if len(ends) <= most_groups and all(math.isfinite(r["lo"]) and math.isfinite(r["hi"]) for r in ends):
            wanted = {(g, p) for g, r in enumerate(ends) for share in quantiles.values() for p in _around(share, r["n"])}
            at = _values_at(rows, keys, ends, wanted)
            kinds = {f.name: f for f in df.schema.fields}
            schema = StructType([*(kinds[k] for k in keys), *(StructField(q, DoubleType()) for q in quantiles), StructField("n", LongType())])
            found = [(*(r[k] for k in keys), *(_between(at, g, share, r["n"]) for share in quantiles.values()), r["n"]) for g, r in enumerate(ends)]
            return df.sparkSession.createDataFrame(found, schema)
    return quantiles_of_many_groups(df, keys, value, quantiles)


def _around(share: float, n: int) -> tuple[int, int]:
    position = share * (n - 1)
    return math.floor(position), math.ceil(position)


def _between(at: dict[tuple[int, int], float], group: int, share: float, n: int) -> float:
    low, high = _around(share, n)
    return at[group, low] + (at[group, high] - at[group, low]) * (share * (n - 1) - low)


def _values_at(rows: DataFrame, keys: list[str], ends: list, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The value at every wanted (group, 0-based position)."""
    spans = {w: (ends[w[0]]["lo"], ends[w[0]]["hi"], 0) for w in wanted}           # range that holds the position, rows below it
    while True:
        open_ = sorted({(g, *spans[g, p]) for g, p in wanted if spans[g, p][0] < spans[g, p][1]})
        if not open_:
            return {w: span[0] for w, span in spans.items()}
        bins = max(16, min(4096, COUNTED // len(open_)))
        held: dict[int, list] = {}
        for r in _counted(rows, keys, ends, open_, bins).collect():
            held.setdefault(r["id"], []).append(r)
        number = {o: i for i, o in enumerate(open_)}
        for (g, p), span in list(spans.items()):
            if span[0] == span[1]:
                continue
            below = span[2]
            for r in sorted(held[number[g, *span]], key=lambda r: r["bin"]):
                if p < below + r["n"]:
                    spans[g, p] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]


def _counted(rows: DataFrame, keys: list[str], ends: list, open_: list, bins: int) -> DataFrame:
    """(id, bin, n, lo, hi) of the rows of each open range; the ranges of a group do not overlap."""
    schema = StructType([*(StructField(f"_k_{f.name}", f.dataType) for f in rows.select(*keys).schema.fields), StructField("id", LongType()), StructField("a", DoubleType()), StructField("b", DoubleType())])
    table = rows.sparkSession.createDataFrame([(*(ends[g][k] for k in keys), i, lo, hi) for i, (g, lo, hi, _) in enumerate(open_)], schema)
    inside = F.col("_v").between(F.col("a"), F.col("b"))
    for k in keys:
        inside = inside & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    # halves, so that a range from one end of the doubles to the other does not overflow
    place = (F.col("_v") / 2 - F.col("a") / 2) / (F.col("b") / 2 - F.col("a") / 2)
    bin_ = F.least(F.floor(place * bins), F.lit(bins - 1))
    return (rows.join(F.broadcast(table), inside).groupBy("id", bin_.alias("bin"))
            .agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))


def quantiles_of_many_groups(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], buckets: int | None = None) -> DataFrame:
    """As `grouped_quantiles`, for any number of groups: nothing comes to the driver."""
    single = not keys
    if single:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    cuts, _ = bucket_cuts(rows, "_v", buckets)
    hist = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    b = with_cuts(hist, "_v", cuts)
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(float(share)).alias("share"))
                       for name, share in quantiles.items()])
    # one row per (group, bucket): at most `buckets` per group
    counts = (b.groupBy(*keys, BUCKET).agg(F.sum("_n").alias("_bn"))
              .select(*keys, BUCKET, "_bn", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"),
                      F.sum("_bn").over(Window.partitionBy(*keys)).alias("_total")))
    asked = F.filter(F.transform(wanted, lambda w: F.struct(w["q"].alias("q"), (w["share"] * (F.col("_total") - 1)).alias("pos"))),
                     lambda w: (F.floor(w["pos"]) < F.col("_off") + F.col("_bn")) & (F.ceil(w["pos"]) >= F.col("_off")))
    targets = (counts.select(*keys, BUCKET, "_off", "_total", asked.alias("_asked")).where(F.size("_asked") > 0))
    inside = Window.partitionBy(*keys, BUCKET).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (b.join(targets, [*keys, BUCKET])
               .withColumn("_last", F.col("_off") + F.sum("_n").over(inside) - 1)
               .select(*keys, "_v", "_last", (F.col("_last") - F.col("_n") + 1).alias("_first"), "_total", F.explode("_asked").alias("_a")))

    def at(rank: Column, name: str) -> Column:
        here = (F.col("_a.q") == name) & (rank >= F.col("_first")) & (rank <= F.col("_last"))
        return F.max(F.when(here, F.col("_v")))

    def value_of(name: str, share: float) -> Column:
        lo, hi = at(F.floor("_a.pos"), name), at(F.ceil("_a.pos"), name)
        pos = F.max("_total").cast("double") - 1
        pos = pos * float(share)
        return lo + (hi - lo) * (pos - F.floor(pos))

    out = ordered.groupBy(*keys).agg(*[value_of(n, q).alias(n) for n, q in quantiles.items()], F.max("_total").alias("n"))
    return out.drop("_all") if single else out


def quantile_values(df: DataFrame, value: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles of one column as driver floats."""
    row = grouped_quantiles(df, [], value, {f"q{i}": s for i, s in enumerate(shares)}).first()
    return [row[f"q{i}"] for i in range(len(shares))]


def quantile_bins(df: DataFrame, value: str, bins: int, out: str) -> DataFrame:
    """0-based (edge, edge] bin between exact quantiles, the lowest value included, repeated edges dropped."""
    edges = sorted(set(quantile_values(df, value, [i / bins for i in range(bins + 1)])))
    which = F.lit(0)
    for i in range(1, len(edges) - 1):
        which = F.when(F.col(value) > edges[i], F.lit(i)).otherwise(which)
    return df.withColumn(out, which.cast("int"))
