"""Lookups and frames on an hourly timeline: lags, leads, weather memory, gaps and runs.

Nothing here opens a window over a whole entity. A timeline (one row per entity and hour) is cut into fixed blocks of
hours, and the few rows near a border are copied into the neighbouring block, so one entity with decades of data is
spread over many tasks."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.operators.audit import lookup

BLOCK_HOURS = 24 * 28


def first_per_hour(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: str,
                   hour: str = "hour_idx") -> DataFrame:
    """One row per key and hour, the first in `order`; combines map-side, so repeated hours cost no shuffle of rows."""
    picked = df.groupBy(*keys, hour).agg(F.min_by(F.struct(*values), F.col(order)).alias("_first"))
    return picked.select(*keys, hour, "_first.*")


def _blocks(hour: str, reach_back: int, reach_ahead: int) -> Column:
    """Blocks whose rows may look at this hour: its own and, near a border, the next or the previous ones."""
    first = F.floor((F.col(hour) - reach_ahead) / BLOCK_HOURS)
    last = F.floor((F.col(hour) + reach_back) / BLOCK_HOURS)
    return F.sequence(first, last)


def shifted(df: DataFrame, timeline: DataFrame | None, keys: Sequence[str], values: dict[str, tuple[str, int]],
            hour: str = "hour_idx", own: dict[str, Column] | None = None) -> DataFrame:
    """Add value columns found a number of hours earlier (negative: later) on a timeline of unique hours.

    `values` maps the new name to (timeline column, hours); no timeline means `df` itself, whose hours are then unique. A
    missing hour gives the row's own value, taken from `own` or from the column of the same name. One shuffle on (keys,
    block of hours) serves all lookups: each is a one-hour RANGE frame over the same sort."""
    own = own or {}
    back = max(0, *[h for _, h in values.values()])
    ahead = max(0, *[-h for _, h in values.values()])
    columns = sorted({c for c, _ in values.values()})
    home = F.floor(F.col(hour) / BLOCK_HOURS)
    if timeline is None:
        looked = {c: F.col(c) for c in columns}
        rows = (df.withColumns({f"_v_{c}": e for c, e in looked.items()}).withColumn("_home", home)
                .withColumn("_block", F.explode(_blocks(hour, back, ahead))).withColumn("_keep", F.col("_block") == F.col("_home")))
    else:
        known = (timeline.select(*keys, hour, *[F.col(c).alias(f"_v_{c}") for c in columns])
                 .withColumn("_block", F.explode(_blocks(hour, back, ahead))).withColumn("_keep", F.lit(False)))
        asking = df.withColumn("_block", home).withColumn("_keep", F.lit(True))
        rows = asking.unionByName(known, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_block").orderBy(hour)
    found = {f"_at_{name}": F.max(f"_v_{c}").over(w.rangeBetween(-h, -h)) for name, (c, h) in values.items()}
    kept = rows.withColumns(found).where("_keep")
    result = {name: F.coalesce(F.col(f"_at_{name}"), own.get(name, F.col(c))) for name, (c, h) in values.items()}
    return kept.withColumns(result).select(*[c for c in df.columns if c not in values], *values)


def weather_memory(df: DataFrame, timeline: DataFrame | None = None, keys: Sequence[str] = (),
                   situation: str = "weathersit", order: str = "instant", hour: str = "hour_idx",
                   unique: bool = False) -> DataFrame:
    """ws_lag1 (situation one hour earlier) and wet3 (worst of the three hours before), both capped at 3.

    An hour missing from the timeline counts as the row's own situation; of rows that share an hour the first in `order`
    is the timeline. `unique` says the hours of `df` never repeat, which saves a shuffle. The label is never read."""
    capped = F.least(F.col(situation), F.lit(3))
    lags = {f"_ws{h}": ("_ws", h) for h in (1, 2, 3)}
    if timeline is None and unique:
        out = shifted(df.withColumn("_ws", capped), None, keys, lags, hour).drop("_ws")
    else:
        source = df if timeline is None else timeline
        known = first_per_hour(source.select(*keys, hour, order, capped.alias("_ws")), keys, ["_ws"], order, hour)
        out = shifted(df, known, keys, lags, hour, own={name: capped for name in lags})
    return (out.withColumns({"ws_lag1": F.col("_ws1").cast("int"), "wet3": F.greatest("_ws1", "_ws2", "_ws3").cast("int")})
            .drop(*lags))


def rolling_extremes(df: DataFrame, keys: Sequence[str], column: Column, hours: int, largest: bool, name: str,
                     hour: str = "hour_idx") -> DataFrame:
    """Largest or smallest value of the `hours` hours before each row of a unique-hour timeline.

    The row's own value stands in for missing hours. One range frame per block of hours."""
    spread = (df.withColumn("_x", column).withColumn("_home", F.floor(F.col(hour) / BLOCK_HOURS))
              .withColumn("_block", F.explode(_blocks(hour, hours, 0))))
    w = Window.partitionBy(*keys, "_block").orderBy(hour).rangeBetween(-hours, -1)
    seen = (F.max if largest else F.min)("_x").over(w)
    pick = F.greatest if largest else F.least
    value = F.when(F.count("_x").over(w) == hours, seen).otherwise(pick(F.col("_x"), seen))
    return (spread.withColumn(name, value).where("_block = _home").drop("_x", "_home", "_block"))


def day_context(df: DataFrame, keys: Sequence[str], aggregates: dict[str, Column], day: str = "dteday") -> DataFrame:
    """Whole-day aggregates on every row of the day: aggregate first, then a measured lookup, so a busy day is never one task."""
    per_day = df.groupBy(*keys, day).agg(*[c.alias(n) for n, c in aggregates.items()])
    return lookup(df, per_day, [*keys, day], "inner")


def missing_hours(df: DataFrame, keys: Sequence[str], day: str = "dteday", hour: str = "hr") -> DataFrame:
    """Hours absent on the days that are present, per key.

    A day's hours are a set of at most 24 numbers, so one aggregation finds what is missing without any join."""
    seen = df.groupBy(*keys, day).agg(F.collect_set(hour).alias("_seen"))
    every = F.sequence(F.lit(0), F.lit(23))
    return seen.select(*keys, day, F.explode(F.array_except(every, "_seen")).alias(hour))


def missing_runs(missing: DataFrame, keys: Sequence[str], day: str = "dteday", hour: str = "hr") -> DataFrame:
    """Runs of consecutive missing hours inside a day (a partition holds at most 24 rows)."""
    island = F.col(hour) - F.row_number().over(Window.partitionBy(*keys, day).orderBy(hour))
    return (missing.withColumn("_island", island).groupBy(*keys, day, "_island")
            .agg(F.min(hour).alias("first_hr"), F.max(hour).alias("last_hr"), F.count("*").alias("n_hours"))
            .drop("_island"))


def next_to_gap(df: DataFrame, keys: Sequence[str], day: str = "dteday", hour: str = "hr") -> DataFrame:
    """Flag rows whose previous or next hour inside the day is missing (midnight borders do not count)."""
    w = Window.partitionBy(*keys, day).orderBy(hour)
    before, after = F.lag(hour).over(w), F.lead(hour).over(w)
    gap_before = (F.col(hour) > 0) & (before.isNull() | (before != F.col(hour) - 1))
    gap_after = (F.col(hour) < 23) & (after.isNull() | (after != F.col(hour) + 1))
    return df.withColumn("adjacent", (gap_before | gap_after).cast("int"))


def flag_runs(df: DataFrame, keys: Sequence[str], flag: Column, hour: str = "hour_idx") -> DataFrame:
    """Lengths of unbroken runs of `flag` in time order per key, counted in rows present.

    Each block of hours finds its own runs with its first and last row marked; runs that touch a block border are
    then stitched on the table that has a few rows per block."""
    block = F.floor(F.col(hour) / BLOCK_HOURS)
    rows = df.select(*keys, F.col(hour).alias("_t"), flag.cast("int").alias("_f"), block.alias("_block"))
    w = Window.partitionBy(*keys, "_block").orderBy("_t")
    local = rows.withColumn("_i", F.row_number().over(w)).withColumn(
        "_j", F.row_number().over(Window.partitionBy(*keys, "_block", "_f").orderBy("_t")))
    size = F.count("*").over(Window.partitionBy(*keys, "_block"))
    islands = (local.withColumn("_size", size).where("_f = 1").groupBy(*keys, "_block", (F.col("_i") - F.col("_j")).alias("_g"))
               .agg(F.count("*").alias("n"), F.min("_t").alias("_t"), F.min("_i").alias("_first"), F.max("_i").alias("_last"),
                    F.max("_size").alias("_size"))
               .select(*keys, "_block", "_t", "n", (F.col("_first") == 1).alias("_opens"),
                       (F.col("_last") == F.col("_size")).alias("_closes")))
    inner = islands.where("not _opens and not _closes").select(*keys, F.col("_t").alias("start"), "n")
    # at most two border runs per block; the block ordinal counts blocks that hold rows at all
    ordinal = rows.select(*keys, "_block").distinct().withColumn(
        "_ord", F.row_number().over(Window.partitionBy(*keys).orderBy("_block")))
    border = islands.where("_opens or _closes").join(ordinal, [*keys, "_block"])
    o = Window.partitionBy(*keys).orderBy("_t")
    glued = (F.col("_opens") & F.lag("_closes").over(o) & (F.lag("_ord").over(o) == F.col("_ord") - 1))
    starts = border.withColumn("_new", F.when(F.coalesce(glued, F.lit(False)), 0).otherwise(1))
    chained = starts.withColumn("_chain", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stitched = chained.groupBy(*keys, "_chain").agg(F.min("_t").alias("start"), F.sum("n").alias("n")).drop("_chain")
    return inner.unionByName(stitched)


def key_order_breaks(df: DataFrame, key: str, time: str) -> DataFrame:
    """One row: how often time steps back when rows are read in key order."""
    from hourwise.operators.ranks import BUCKET, with_bucket
    b = with_bucket(df.select(key, time), key)
    inside = b.withColumn("_prev", F.lag(time).over(Window.partitionBy(BUCKET).orderBy(key)))
    per_bucket = inside.groupBy(BUCKET).agg(
        F.sum((F.col(time) < F.col("_prev")).cast("bigint")).alias("breaks"), F.count("*").alias("n"),
        F.min_by(time, key).alias("_head"), F.max_by(time, key).alias("_tail"))
    # one row per bucket
    linked = per_bucket.withColumn("_before", F.lag("_tail").over(Window.orderBy(BUCKET)))
    total = F.sum(F.coalesce(F.col("breaks"), F.lit(0)) + F.coalesce((F.col("_head") < F.col("_before")).cast("int"), F.lit(0)))
    return linked.agg(F.sum("n").alias("n_rows"), total.cast("bigint").alias("n_breaks")).withColumn(
        "monotone", F.col("n_breaks") == 0)
