"""Gram matrices of plain columns or of one array column."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.plans.moments import collect_rows, full_matrix, matrix_of, sum_rows

BUILT_IN_LIMIT = 30        # above this many columns the sums are taken on Arrow batches


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def gram_table(df: DataFrame, columns: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, a, b, value): mean product of every pair of columns, a before b, as built-in aggregates."""
    names = list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    named = df.select(*keys, *[columns[n].cast("double").alias(n) for n in names])
    wide = named.groupBy(*keys).agg(*[F.avg(F.col(a) * F.col(b)).alias(f"v{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"v{i}").alias("value")) for i, (a, b) in enumerate(pairs)])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def array_gram_sums(df: DataFrame, array: str, key: Column | None = None) -> DataFrame:
    """(key, i, v): upper-triangle sums of products of one array column, row i from column i on; v[0][0] of a leading
    ones column would be the row count, so one is added in front."""
    rows = df.select((key if key is not None else F.lit(0)).cast("int").alias("key"), F.col(array).cast("array<double>").alias("x"))

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x = matrix_of(b.column("x"))
            x = np.column_stack([np.ones(len(x)), x])
            k = b.column("key").to_numpy(zero_copy_only=False)
            for g in np.unique(k):
                part = x[k == g]
                total[int(g)] = total.get(int(g), 0.0) + part.T @ part
        for g, m in total.items():
            for i, row in enumerate(m):
                yield g, i, row[i:]

    return sum_rows(rows, partial)


def array_gram(df: DataFrame, array: str, key: Column | None = None) -> dict[int, np.ndarray]:
    """Sums of products with a leading ones column, per key, on the driver (size set by the array length)."""
    return {k: full_matrix([r[i] for i in range(len(r))]) for k, r in collect_rows(array_gram_sums(df, array, key)).items()}


def normal_equations(df: DataFrame, y: Column | str, columns: Sequence[Column | str], weight: Column | None = None):
    """(gram, cross, mean square of y) with the bias first, each a (weighted) mean over the rows."""
    xs = [F.lit(1.0), *[_c(c).cast("double") for c in columns], _c(y).cast("double")]
    w = F.lit(1.0) if weight is None else weight
    if len(xs) - 2 > BUILT_IN_LIMIT:
        root = F.sqrt(w)
        sums = array_gram(df.select(F.array(*[x * root for x in xs]).alias("x")), "x")[0][1:, 1:]
    else:
        pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
        named = df.select(w.cast("double").alias("_w"), *[x.alias(f"x{i}") for i, x in enumerate(xs)])
        row = named.agg(*[F.sum(F.col("_w") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs]).first()
        sums = np.zeros((len(xs), len(xs)))
        for i, j in pairs:
            sums[i, j] = sums[j, i] = row[f"s{i}_{j}"]
    sums = sums / sums[0, 0]
    return sums[:-1, :-1], sums[:-1, -1], float(sums[-1, -1])
