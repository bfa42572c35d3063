"""One pass of sums that serves every plan, fold and penalty.

The rows are turned into monomials of roughly standardised first-order columns inside each Arrow batch, and tasks send
only sums of products. A design learned on any union of row classes (folds, sides of a split) is a linear map of the
same monomials, so its standardised Gram matrix follows from the sums by algebra, with its own means, deviations and
humidity fill: no further pass over the rows is needed to fit another fold, plan or penalty."""
from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.functions.target import PowerTarget
from hourwise.plans.design import Design, raw_columns
from hourwise.plans.spec import DesignSpec, factors

FAULT = "#fault"
ONE: tuple[str, ...] = ()
Poly = dict[tuple[str, ...], float]


def _times(a: Poly, b: Poly) -> Poly:
    """Product of two polynomials; a faulty reading has value 0, so hum times the fault flag vanishes."""
    out: Poly = {}
    for m, x in a.items():
        for n, y in b.items():
            mono = tuple(sorted(m + n))
            if FAULT in mono:
                if "hum" in mono:
                    continue
                mono = tuple(v for v in mono if v != FAULT) + (FAULT,)
                mono = tuple(sorted(mono))
            out[mono] = out.get(mono, 0.0) + x * y
    return out


DIRECT_BYTES = 1 << 25       # sums of all tasks up to this size are added up by the reader instead of a second stage


def is_small(tasks: int, bytes_each: int) -> bool:
    """Whether the sums of all tasks may go straight to the driver: their number and size are known before they are made."""
    return tasks * bytes_each <= DIRECT_BYTES


def sum_rows(df: DataFrame, partial: Callable[[Iterable], Iterable[tuple[int, int, np.ndarray]]], largest: int = -1, direct: bool = False) -> DataFrame:
    """(key, i, v): vectors that tasks emit per (key, i), added up by a second Arrow stage partitioned on (key, i).

    Vectors travel as the bytes of their doubles. Row number `largest` is merged by maximum instead of sum. With `direct` the
    second stage is left to `collect_rows`."""
    schema = "key int, i int, v binary"

    def emit(items):
        keys, rows, vectors, size = [], [], [], 0
        for key, i, v in items:
            keys.append(key), rows.append(i), vectors.append(np.asarray(v, float).tobytes())
            size += len(vectors[-1])
            if size > 1 << 23:
                yield _batch(keys, rows, vectors)
                keys, rows, vectors, size = [], [], [], 0
        if keys:
            yield _batch(keys, rows, vectors)

    def first(batches):
        yield from emit(partial(b for b in batches if b.num_rows))

    def merge(batches):
        yield from emit((k, i, v) for (k, i), v in _merged(batches, largest).items())

    sent = df.mapInArrow(first, schema)
    return sent if direct else sent.repartition("key", "i").mapInArrow(merge, schema)


def _merged(batches, largest: int) -> dict[tuple[int, int], np.ndarray]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for key, i, v in _entries(b):
            if (key, i) not in total:
                total[key, i] = v.copy()
            elif i == largest:
                total[key, i] = np.maximum(total[key, i], v)
            else:
                total[key, i] += v
    return total


def _batch(keys, rows, vectors):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(rows, pa.int32()), pa.array(vectors, pa.binary())],
                                      ["key", "i", "v"])


def _entries(batch):
    for key, i, v in zip(batch.column("key").to_pylist(), batch.column("i").to_pylist(), batch.column("v")):
        yield key, i, np.frombuffer(v.as_buffer())


def matrix_of(column) -> np.ndarray:
    """(rows, width) from a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def collect_rows(sums: DataFrame, largest: int = -1) -> dict[int, dict[int, np.ndarray]]:
    """The merged sums on the driver: their size is set by the plan, not by the data."""
    out: dict[int, dict[int, np.ndarray]] = {}
    for (key, i), v in _merged(sums.toArrow().to_batches(), largest).items():
        out.setdefault(key, {})[i] = v
    return out


def first_columns(specs: Sequence[DesignSpec]) -> list[str]:
    return list(dict.fromkeys(n for s in specs for n in s.first_order))


def packed_columns(specs: Sequence[DesignSpec], epoch: str, own: dict[str, Column] | None = None) -> Column:
    """The first-order columns of several plans as one array<double>."""
    raw = raw_columns(epoch, own)
    return F.array(*[raw[n] for n in first_columns(specs)])


@dataclass
class Basis:
    """First-order columns with a rough centre and scale, and the monomials that span some plans."""
    first: list[str]
    centre: np.ndarray
    scale: np.ndarray
    monomials: list[tuple[str, ...]]

    @classmethod
    def over(cls, rows: DataFrame, specs: Sequence[DesignSpec], tasks: int | None = None) -> Basis:
        """Rough centre and scale from one light pass over packed rows; they only keep the sums well scaled and cancel
        out later."""
        first = first_columns(specs)

        def partial(batches):
            total = np.zeros((2, len(first) + 1))
            for b in batches:
                x = matrix_of(b.column("x"))
                total += np.vstack([np.r_[len(x), x.sum(0)], np.r_[0.0, (x * x).sum(0)]])
            yield 0, 0, total.ravel()

        direct = tasks is not None and is_small(tasks, 16 * (len(first) + 1))
        t = collect_rows(sum_rows(rows.select("x"), partial, direct=direct))[0][0].reshape(2, -1)
        centre = t[0, 1:] / t[0, 0]
        scale = np.sqrt(np.clip(t[1, 1:] / t[0, 0] - centre ** 2, 0.0, None))
        scale[~(scale > 1e-9 * np.maximum(np.abs(centre), 1e-3))] = 1.0
        basis = cls(first, centre, scale, [])
        probe = {n: (0.37, 1.3) for n in first}
        found: dict[tuple[str, ...], None] = {ONE: None}
        for n in first:
            found.update(dict.fromkeys(basis.first_poly(n, *probe[n], fill=0.61)))
        for name in dict.fromkeys(t for s in specs for t in s.derived):
            found.update(dict.fromkeys(basis.term_poly(name, probe, 0.61)))
        basis.monomials = list(found)
        return basis

    def first_poly(self, name: str, mean: float, std: float, fill: float | None) -> Poly:
        """(x - mean) / std as a polynomial of the scaled columns."""
        j = self.first.index(name)
        b = (self.centre[j] - mean) / std
        out = {(name,): self.scale[j] / std, ONE: b}
        if name == "hum":
            out[(FAULT,)] = (fill - mean) / std - b
        return out

    def term_poly(self, name: str, stats: dict[str, tuple[float, float]], fill: float) -> Poly:
        out: Poly = {ONE: 1.0}
        for column, power in factors(name).items():
            one = self.first_poly(column, *stats[column], fill)
            for _ in range(power):
                out = _times(out, one)
        return out

    def expand(self, x: np.ndarray) -> np.ndarray:
        """(rows, monomials) of a packed block."""
        u = (x - self.centre) / self.scale
        columns = {n: u[:, j] for j, n in enumerate(self.first)}
        if "hum" in columns:
            fault = x[:, self.first.index("hum")] == 0.0
            columns["hum"] = np.where(fault, 0.0, columns["hum"])
            columns[FAULT] = fault.astype(float)
        out = np.empty((len(x), len(self.monomials)))
        done: dict[tuple[str, ...], int] = {}
        for k, mono in enumerate(self.monomials):
            if not mono:
                out[:, k] = 1.0
            elif len(mono) > 1 and mono[:-1] in done:
                out[:, k] = out[:, done[mono[:-1]]] * columns[mono[-1]]
            else:
                value = columns[mono[0]]
                for n in mono[1:]:
                    value = value * columns[n]
                out[:, k] = value
            done[mono] = k
        return out

    def rows(self, polys: Sequence[Poly]) -> np.ndarray:
        at = {m: k for k, m in enumerate(self.monomials)}
        out = np.zeros((len(polys), len(self.monomials)))
        for r, poly in enumerate(polys):
            for m, c in poly.items():
                out[r, at[m]] = c
        return out


@dataclass
class Moments:
    """Sums over some rows: products of [monomials, transformed labels, label] and the largest label."""
    products: np.ndarray
    n_mono: int
    powers: tuple[float, ...]
    top: float

    @property
    def n(self) -> float:
        return float(self.products[0, 0])

    @cached_property
    def gram(self) -> np.ndarray:
        return self.products[:self.n_mono, :self.n_mono] / self.n

    def cross(self, power: float) -> np.ndarray:
        return self.products[:self.n_mono, self.n_mono + self.powers.index(power)] / self.n

    def label_square(self, power: float) -> float:
        j = self.n_mono + self.powers.index(power)
        return float(self.products[j, j] / self.n)

    def plus(self, other: Moments) -> Moments:
        return Moments(self.products + other.products, self.n_mono, self.powers, max(self.top, other.top))


LARGEST = -1


STRIPE_BYTES = 1 << 26       # products that a task holds at once
EXPANDED_ROWS = 4096         # rows whose monomials a task holds at once


def stripes(width: int, classes: int) -> list[tuple[int, int]]:
    """Columns lo..hi of a Gram matrix for each pass, so that the rows of products held for all classes stay within STRIPE_BYTES."""
    size = max(1, STRIPE_BYTES // (8 * width * max(1, classes)))
    return [(lo, min(lo + size, width)) for lo in range(0, width, size)]


def moment_sums(rows: DataFrame, basis: Basis, powers: Sequence[float], direct: bool = False, stripe: tuple[int, int] | None = None) -> DataFrame:
    """(key, i, v) sums of a frame (key int, x array<double>, y double): row i of the upper triangle of products, for the
    rows of a stripe (all of them by default)."""
    lo, hi = stripe or (0, len(basis.monomials) + len(powers) + 1)
    targets = [PowerTarget(p, "none") for p in powers]

    def partial(batches):
        total: dict[int, np.ndarray] = {}
        top: dict[int, float] = {}

        def add(key, products, largest):
            if key in total:
                total[key] += products
                top[key] = max(top[key], largest)
            else:
                total[key], top[key] = products, largest

        for b in (b.slice(at, EXPANDED_ROWS) for b in batches for at in range(0, b.num_rows, EXPANDED_ROWS)):
            y = b.column("y").to_numpy(zero_copy_only=False)
            a = np.column_stack([basis.expand(matrix_of(b.column("x"))), *[t.forward_np(y) for t in targets], y])
            key = b.column("key").to_numpy(zero_copy_only=False)
            for k in np.unique(key):
                mine = a[key == k]
                add(int(k), mine[:, lo:hi].T @ mine[:, lo:], float(y[key == k].max()))
        for k, p in total.items():
            for i, row in enumerate(p):
                yield k, lo + i, row[i:]                # symmetric: the upper triangle is enough
            if lo == 0:
                yield k, LARGEST, np.array([top[k]])

    return sum_rows(rows, partial, LARGEST, direct)


def collect_moments(rows: DataFrame, basis: Basis, powers: Sequence[float], tasks: int | None = None, classes: int = 1) -> dict[int, Moments]:
    """Sums of every row class, in as many passes as there are stripes of columns. `tasks` and `classes` say how many triangles
    there can be before they are merged."""
    width, sums = len(basis.monomials) + len(powers) + 1, {}
    for lo, hi in stripes(width, classes):
        direct = tasks is not None and is_small(tasks, 8 * (hi - lo) * (width - lo) * classes)
        for k, part in collect_rows(moment_sums(rows, basis, powers, direct, (lo, hi)), LARGEST).items():
            sums.setdefault(k, {}).update(part)
    q = len(basis.monomials)
    return {k: Moments(full_matrix([r[i] for i in range(len(r) - 1)]), q, tuple(powers), float(r[LARGEST][0])) for k, r in sums.items()}


def full_matrix(upper: Sequence[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(upper), len(upper)))
    for i, row in enumerate(upper):
        out[i, i:] = row
        out[i:, i] = row
    return out


def design_from(basis: Basis, spec: DesignSpec, epoch: str, m: Moments, fill: float) -> tuple[Design, np.ndarray]:
    """(design learned on the rows behind `m`, its standardised columns as rows over the monomials, bias first)."""
    d = Design(spec, epoch, fill=fill)
    g = m.gram
    first = basis.rows([basis.first_poly(n, 0.0, 1.0, fill) for n in spec.first_order])

    def learn(names, maps):
        # deviations from a centred map: subtract the mean before squaring
        means = maps @ g[:, 0]
        centred = maps.copy()
        centred[:, 0] -= means
        var = ((centred @ g) * centred).sum(axis=1)
        scale = (maps ** 2) @ np.diag(g)
        for n, mean, v, s in zip(names, means, var, scale):
            d.set_stat(n, mean, np.sqrt(v) if v > 1e-13 * max(s, 1e-30) else 0.0)
        return centred

    first_c = learn(spec.first_order, first)
    rows = [np.eye(1, len(basis.monomials))[0]]
    rows += [first_c[i] / d.std[n] for i, n in enumerate(spec.first_order)]
    stats = {n: (d.mean[n], d.std[n]) for n in spec.first_order}
    if spec.derived:
        maps = basis.rows([basis.term_poly(n, stats, fill) for n in spec.derived])
        derived_c = learn(spec.derived, maps)
        rows += [derived_c[i] / d.std[n] for i, n in enumerate(spec.derived)]
    return d, np.vstack(rows)
