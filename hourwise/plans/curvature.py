"""Models without a closed form: every step is one pass that adds up loss, gradient and curvature of all models at once.

A step solves (H + damping) d = g on the driver; the next pass tells whether the loss fell. Costs that differ only in
label, columns or penalty (label rules, l2 sweeps, cost ratios) share the passes."""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.functions.target import PowerTarget
from hourwise.plans.moments import Basis, collect_rows, matrix_of, sum_rows

STEP_TOL = 1e-8           # a fit has converged when the undamped step, the gradient over the curvature, is this small beside the weights

@dataclass
class Objective:
    """One cost: kind, the columns it uses (bias first), which label, penalty on the weights but the bias.

    `cost(eta, y)` gives per-row (loss, d loss / d eta, curvature); it may be any function of that form."""
    name: str
    cost: object
    columns: np.ndarray
    label: int = 0
    alpha: float = 0.0
    start: np.ndarray | None = None
    w: np.ndarray = field(default=None)
    loss: float = float("inf")
    steps: int = 0
    stop: str = "max_iter"
    grad_norm: float = float("nan")


def squared(eta, y):
    r = eta - y
    return 0.5 * r * r, r, np.ones_like(r)


def logistic(eta, y):
    e = np.exp(-np.abs(eta))
    p = np.where(eta >= 0, 1.0 / (1.0 + e), e / (1.0 + e))
    return np.maximum(eta, 0.0) + np.log1p(e) - y * eta, p - y, np.maximum(p * (1.0 - p), 1e-12)


def poisson(eta, y):
    mu = np.exp(eta)
    return mu - y * eta, mu - y, mu


def log_link_squares(eta, y):
    mu = np.exp(eta)
    r = mu - y
    return 0.5 * r * r, r * mu, mu * mu


@dataclass(frozen=True)
class UnderPrediction:
    """Squared cost on the count scale, k times as dear when the prediction is too low."""
    target: PowerTarget
    k: float
    cap: float

    def first_bias(self, mean: float) -> float:
        """Score at which the prediction is the mean label."""
        return float(self.target.forward_np(np.array([mean]))[0])

    def __call__(self, eta, y):
        held = np.minimum(eta, self.cap)
        q = self.target.inverse_np(held)
        slope = q ** (1.0 - self.target.power) * (eta <= self.cap)
        r = q - 1.0 - y
        c = np.where(r < 0, self.k, 1.0)
        return c * r * r, 2.0 * c * r * slope, 2.0 * c * slope * slope


def _pass(rows: DataFrame, basis: Basis | None, maps: np.ndarray | None, objectives: Sequence[Objective], points: Sequence[np.ndarray]):
    """(n, loss, gradient, curvature) per objective at one point each."""
    spec = [(o.cost, o.columns, o.label, w) for o, w in zip(objectives, points)]

    def partial(batches):
        total = [None] * len(spec)
        for b in batches:
            x = matrix_of(b.column("x"))
            if basis is not None:
                x = basis.expand(x) @ maps.T
            ys = matrix_of(b.column("ys"))
            for i, (cost, columns, label, w) in enumerate(spec):
                xi = x[:, columns]
                with np.errstate(over="ignore", invalid="ignore"):
                    loss, slope, curve = cost(xi @ w, ys[:, label])
                part = [np.array([len(loss), loss.sum()]), xi.T @ slope, (xi * curve[:, None]).T @ xi]
                total[i] = part if total[i] is None else [a + p for a, p in zip(total[i], part)]
        for i, part in enumerate(total):
            if part is not None:
                yield i, 0, part[0]
                yield i, 1, part[1]
                for j, row in enumerate(part[2]):
                    yield i, 2 + j, row

    got = collect_rows(sum_rows(rows, partial))
    out = []
    for i, o in enumerate(objectives):
        n, loss = got[i][0]
        w = points[i]
        penal = np.r_[0.0, np.full(len(w) - 1, o.alpha)]
        out.append((float(loss / n + 0.5 * (penal * w * w).sum()), got[i][1] / n + penal * w,
                    np.vstack([got[i][2 + j] for j in range(len(w))]) / n + np.diag(penal)))
    return out


def minimise(rows: DataFrame, objectives: Sequence[Objective], basis: Basis | None = None, maps: np.ndarray | None = None,
             max_iter: int = 100) -> list[Objective]:
    """Damped Newton / Gauss-Newton steps for all objectives together, from `start` or from the score of the mean label.

    Each ends as `converged` (the gradient, measured by the curvature, is small), `stalled` (no damped step lowers the loss
    though the gradient is not small) or `max_iter`. Scores are never cut: a step that overflows is damped.

    `rows` holds ys array<double> (labels) and x array<double>: design columns with the bias first, or packed first-order
    columns when a basis and the maps of a design are given."""
    _set_starts(rows, objectives)
    state = {}
    for o, (loss, g, h) in zip(objectives, _pass(rows, basis, maps, objectives, [o.w for o in objectives])):
        o.loss, o.grad_norm = loss, float(np.linalg.norm(g))
        state[o.name] = [g, h, 1e-3]
        o.stop = "converged" if _small(_newton(g, h), o.w) else "max_iter"
    live = [o for o in objectives if o.stop != "converged"]
    for _ in range(max_iter):
        if not live:
            break
        tries = []
        for o in live:
            g, h, damping = state[o.name]
            tries.append(o.w - _newton(g, h + damping * np.diag(np.maximum(np.diag(h), 1e-300))))
        for o, w, (loss, g, h) in zip(live, tries, _pass(rows, basis, maps, live, tries)):
            o.steps += 1
            old_g, old_h, damping = state[o.name]
            finite = np.isfinite(loss) and np.isfinite(g).all() and np.isfinite(h).all()
            # at the working precision of the loss the gradient decides
            level = finite and abs(loss - o.loss) <= 1e-13 * max(1.0, abs(o.loss)) and g @ _newton(g, h) < old_g @ _newton(old_g, old_h)
            if finite and (loss < o.loss or level):
                o.w, o.loss, o.grad_norm = w, loss, float(np.linalg.norm(g))
                state[o.name] = [g, h, max(damping / 10.0, 1e-12)]
                if _small(_newton(g, h), w):
                    o.stop = "converged"
            else:
                state[o.name][2] = damping * 10.0
                if damping > 1e8:
                    o.stop = "converged" if _small(_newton(old_g, old_h), o.w) else "stalled"
        live = [o for o in live if o.stop == "max_iter"]
    return list(objectives)


def _newton(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(h, g, rcond=None)[0]


def _small(step: np.ndarray, w: np.ndarray) -> bool:
    return bool(np.abs(step).max() <= STEP_TOL * max(1.0, float(np.abs(w).max())))


def _set_starts(rows: DataFrame, objectives: Sequence[Objective]) -> None:
    """Weights given, or zero with the bias at the score of the mean label where the cost knows one."""
    wanted = sorted({o.label for o in objectives if o.start is None and _first_bias(o.cost)})
    means = dict(zip(wanted, rows.agg(*[F.avg(F.col("ys")[k]).alias(f"m{k}") for k in wanted]).first())) if wanted else {}
    for o in objectives:
        if o.start is not None:
            o.w = np.asarray(o.start, float).copy()
            continue
        o.w = np.zeros(len(o.columns))
        mean = means.get(o.label)
        if mean is not None and mean > 0:
            o.w[0] = _first_bias(o.cost)(mean)


def _first_bias(cost):
    return math.log if cost in (poisson, log_link_squares) else getattr(cost, "first_bias", None)
