"""Numbers 1, 2, 3 ... in a given order without a window over the table.

Rows are dealt to partitions by ranges of the order and sorted there; the number of a row is its place in its partition plus
the rows of the partitions before. The sorted rows are checkpointed, so that counts and places come from the same dealing.
The table of counts has one row per partition."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourwise.session import cut_lineage

_PLACES = 33                 # monotonically_increasing_id: partition number above this bit, place in the partition below


def numbered(df: DataFrame, order: Sequence[Column], name: str = "row_no", ties: Column | None = None) -> DataFrame:
    """`df` with the 1-based bigint `name` in `order`.

    Rows equal in all of `order` share a partition; `ties`, a column that tells them apart, spreads them and orders them last.
    Without it the order among equal rows is arbitrary, but fixed once numbered."""
    keys = list(order)
    if ties is not None:
        df = df.withColumn("_ties", ties)
        keys.append(F.col("_ties"))
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_spot", F.monotonically_increasing_id())
    dealt = cut_lineage(dealt.drop("_ties"))
    part = F.shiftright("_spot", _PLACES)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)             # one row per partition
    offsets = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_spot").bitwiseAND(F.lit((1 << _PLACES) - 1))
    return dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_spot", "_before")
