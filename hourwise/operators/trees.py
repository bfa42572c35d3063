"""Boosted trees from histograms, for any loss that is given by its slopes.

Columns are cut at approximate quantiles into at most `bins` bins, a byte each; rows equal in all bytes become one row with
their number and the sum of their labels, since they share every score. A round grows one tree level by level: a pass over
these rows adds up gradient, curvature and number of rows per open node, column and bin in the tasks, the sums (their size
is set by nodes, columns and bins) are merged by Spark and come to the driver, which picks the best cut of every open node. The scores
of the rows move on in the first pass of the next round. They are kept (memory, then disk), and a reliable checkpoint cuts their
lineage every `CUT_ROUNDS` rounds.

A missing value has bin 0 and goes left of every cut. Ties take the earlier column, then the lower cut."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from hourwise.functions.target import PowerTarget
from hourwise.plans.moments import collect_rows, is_small, sum_rows
from hourwise.session import cut_lineage

CUT_ROUNDS = 25
MOST_BINS = 250              # a bin is a byte


@dataclass(frozen=True)
class Loss:
    """start(n, s): the constant score of n rows with label sum s; slopes(f, n, s): gradient and curvature at scores f of
    groups of n rows with label sum s; mean(f): the prediction."""
    start: Callable[[float, float], float]
    slopes: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    mean: Callable[[np.ndarray], np.ndarray]


def _probability(f):
    return 0.5 * (1.0 + np.tanh(0.5 * f))


def _logit(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


SQUARED = Loss(lambda n, s: s / n, lambda f, n, s: (n * f - s, n), lambda f: f)
POISSON = Loss(lambda n, s: float(np.log(max(s, 1e-9) / n)), lambda f, n, s: (n * np.exp(f) - s, n * np.exp(f)), np.exp)
LOGISTIC = Loss(lambda n, s: _logit(s / n), lambda f, n, s: (n * _probability(f) - s, n * _probability(f) * (1 - _probability(f))), _probability)


@dataclass
class Tree:
    """Nodes as parallel lists; column -1 marks a leaf."""
    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, column: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        """Two new leaves below a node; rows with a bin up to `cut` go to the first."""
        at = len(self.column)
        self.column[node], self.cut[node], self.left[node] = column, cut, at
        for v in values:
            self.column.append(-1), self.cut.append(0), self.left.append(0), self.value.append(v)
        return at, at + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins."""
        column, cut, left = (np.array(x) for x in (self.column, self.cut, self.left))
        node, row = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(self.depth):
            inner = column[node] >= 0
            below = left[node] + (bins[row, np.maximum(column[node], 0)] > cut[node])
            node = np.where(inner, below, node)
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosted:
    """A fitted model: bin edges of the columns, the first score and the trees."""
    features: list[str]
    edges: list[np.ndarray]
    loss: Loss
    first: float
    trees: list[Tree]
    stop: str = "rounds"

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """(rows, columns) bytes: 0 for missing, else one more than the number of edges below the value."""
        out = np.zeros((len(columns[0]), len(columns)), np.uint8)
        for j, (x, e) in enumerate(zip(columns, self.edges)):
            out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "left"))
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.first)
        for t in self.trees:
            out += t.scores(bins)
        return out

    def predict(self, new: DataFrame, out: str = "pred", as_score: bool = False) -> DataFrame:
        """`new` with the prediction (or the score) of every row."""
        schema = StructType([*new.schema.fields, StructField(out, DoubleType())])
        arrow = to_arrow_schema(schema)

        def run(batches):
            for b in batches:
                f = self.scores(self.bins(_floats(b, self.features))) if b.num_rows else np.zeros(0)
                p = f if as_score else self.loss.mean(f)
                yield pa.RecordBatch.from_arrays([*(c.cast(t.type) for c, t in zip(b.columns, arrow)), pa.array(p, pa.float64())], schema=arrow)
        return new.mapInArrow(run, schema)


def _floats(batch, names) -> list[np.ndarray]:
    return [batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges at approximate quantiles of every column, from one pass; the last bin is open."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 50 * bins).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(e if e is not None else [], float)) for e in row]


def binned_rows(df: DataFrame, model: Boosted, label: str) -> DataFrame:
    """(bins, n, s, f): rows equal in all bins as one, with their number, label sum and first score."""
    names = [f"x{i}" for i in range(len(model.features))]
    source = df.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(model.features, names)], F.col(label).cast("double").alias("y"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                held = model.bins(_floats(b, names))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in held], pa.binary()), b.column("y")], names=["bins", "y"])
    binned = source.mapInArrow(run, "bins binary, y double")
    return binned.groupBy("bins").agg(F.count("y").cast("double").alias("n"), F.sum("y").alias("s")).where("n > 0")


def _arrays(batch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "s", "f"))


def histograms(rows: DataFrame, tree: Tree, open_nodes: Sequence[int], loss: Loss, width: int, bins: int, tasks: int) -> dict[int, np.ndarray]:
    """{node: (columns, 3, bins) sums of gradient, curvature and rows} of the open nodes, in one pass."""
    place = np.full(len(tree.column), -1)
    place[list(open_nodes)] = np.arange(len(open_nodes))

    def partial(batches):
        total = np.zeros((len(open_nodes), width, 3, bins))
        for b in batches:
            x, n, s, f = _arrays(b, width)
            at = place[tree.nodes(x)]
            x, n, s, f, at = (v[at >= 0] for v in (x, n, s, f, at))
            g, h = loss.slopes(f, n, s)
            for j in range(width):
                spot = at * bins + x[:, j]
                for k, v in enumerate((g, h, n)):
                    total[:, j, k] += np.bincount(spot, v, len(open_nodes) * bins).reshape(-1, bins)
        for i in range(len(open_nodes)):
            for j in range(width):
                yield i, j, total[i, j].ravel()
    sums = collect_rows(sum_rows(rows, partial, direct=is_small(tasks, 24 * bins * width * len(open_nodes))))
    return {node: np.stack([sums[i][j].reshape(3, bins) for j in range(width)]) for i, node in enumerate(open_nodes)}


def best_cut(hist: np.ndarray, l2: float, least_rows: int) -> tuple[float, int, int] | None:
    """(gain, column, cut) of the best cut of a node; None if no cut leaves `least_rows` rows on both sides and gains."""
    below = hist.cumsum(axis=2)[:, :, :-1]
    g, h, n = (below[:, k] for k in range(3))
    all_g, all_h, all_n = (hist[0, k].sum() for k in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g ** 2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g ** 2 / (all_h + l2)
    gain = np.where((n >= least_rows) & (all_n - n >= least_rows) & np.isfinite(gain), gain, -np.inf)
    at = int(gain.argmax())
    column, cut = divmod(at, gain.shape[1])
    return (float(gain[column, cut]), column, cut) if gain[column, cut] > 1e-12 * max(1.0, all_n) else None


def grow(rows: DataFrame, loss: Loss, width: int, bins: int, depth: int, rate: float, l2: float, least_rows: int, tasks: int) -> Tree:
    tree, open_nodes = Tree(depth=depth), [0]
    for _ in range(depth):
        held = histograms(rows, tree, open_nodes, loss, width, bins, tasks)
        fresh = []
        for node in open_nodes:
            found = best_cut(held[node], l2, least_rows)
            if found is None:
                continue
            _, column, cut = found
            sides = held[node][column, :, :cut + 1].sum(1), held[node][column, :, cut + 1:].sum(1)
            children = tree.split(node, column, cut, tuple(-rate * g / (h + l2) for g, h, _ in sides))
            fresh += [c for c, (_, _, n) in zip(children, sides) if n >= 2 * least_rows]
        open_nodes = fresh
        if not open_nodes:
            break
    return tree


def _moved(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    def run(batches):
        for b in batches:
            x, n, s, f = _arrays(b, width)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bins", "n", "s")), pa.array(f + tree.scores(x))], names=["bins", "n", "s", "f"])
    return rows.mapInArrow(run, "bins binary, n double, s double, f double")


def boosted(fit: DataFrame, features: Sequence[str], label: str, loss: Loss = SQUARED, rounds: int = 300, depth: int = 4, rate: float = 0.1,
            bins: int = 128, l2: float = 1.0, least_rows: int = 10) -> Boosted:
    """Trees for the rows of `fit`; rows without a label are left out. `stop` says 'rounds', or 'no cut' if no cut gains any more."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"2 to {MOST_BINS} bins")
    model = Boosted(list(features), bin_edges(fit, features, bins), loss, 0.0, [])
    grouped = cut_lineage(binned_rows(fit, model, label))
    total = grouped.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    if not total["n"]:
        raise ValueError("no rows with a label")
    model.first = loss.start(total["n"], total["s"])
    width, size = len(model.features), 2 + max(len(e) for e in model.edges)
    rows, held, tasks = grouped.withColumn("f", F.lit(model.first)), [], grouped.rdd.getNumPartitions()
    try:
        for r in range(rounds):
            rows = cut_lineage(rows) if r and r % CUT_ROUNDS == 0 else rows
            held.append(rows.persist(StorageLevel.MEMORY_AND_DISK))
            tree = grow(rows, loss, width, size, depth, rate, l2, least_rows, tasks)
            for old in held[:-1]:
                old.unpersist()
            held = held[-1:]
            if tree.column[0] < 0:
                model.stop = "no cut"
                break
            model.trees.append(tree)
            rows = _moved(rows, tree, width)
    finally:
        for old in held:
            old.unpersist()
    return model


def boosted_regression(fit: DataFrame, new: DataFrame, features: Sequence[str], label: str, out: str = "pred", **settings) -> DataFrame:
    """Counts of `new` by Poisson trees with a log link."""
    return boosted(fit, features, label, POISSON, **settings).predict(new, out)


def boosted_classifier(fit: DataFrame, new: DataFrame, features: Sequence[str], label: str, out: str = "p", **settings) -> DataFrame:
    """Probability of a 0/1 label by logistic trees."""
    return boosted(fit, features, label, LOGISTIC, **settings).predict(new, out)


def stacked_residual(fit: DataFrame, new: DataFrame, features: Sequence[str], label: str, eta: str, power: float, out: str = "pred", **settings) -> DataFrame:
    """Squared-loss trees on what a linear score leaves over; the two scores are added before the back-transform."""
    target = PowerTarget(power, "ls")
    model = boosted(fit.withColumn("_resid", target.forward(label) - F.col(eta)), features, "_resid", SQUARED, **settings)

    def total(df: DataFrame) -> DataFrame:
        return model.predict(df, "_add").withColumn("_eta", F.col(eta) + F.col("_add"))
    row = total(fit).agg(target.factor_column("_eta", label).alias("s"), F.max(label).alias("top")).first()
    counts = target.counts(target.capped("_eta", target.cap(float(row["top"]))), row["s"])
    return total(new).withColumn(out, counts).drop("_eta", "_add")
