"""The power family of label transforms, its inverse and the way a linear score becomes a count."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_FLOOR = 1e-9
BACK_METHODS = ("none", "ls", "duan")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class PowerTarget:
    """z = ((y + 1)^power - 1) / power, or log(1 + y) at power 0, with its back-transform method."""
    power: float = 0.1
    back: str = "ls"

    def __post_init__(self) -> None:
        if self.back not in BACK_METHODS:
            raise ValueError(f"unknown back-transform {self.back!r}")
        if self.back == "duan" and self.power != 0:
            raise ValueError("the smearing factor exists at power 0 only")

    # Column form, for selects
    def forward(self, y: Column | str) -> Column:
        y = _col(y).cast("double")
        return F.log1p(y) if self.power == 0 else (F.pow(y + 1.0, F.lit(self.power)) - 1.0) / self.power

    def inverse(self, eta: Column | str) -> Column:
        """y + 1 implied by a linear score."""
        eta = _col(eta)
        if self.power == 0:
            return F.exp(eta)
        return F.pow(F.greatest(eta * self.power + 1.0, F.lit(BASE_FLOOR)), F.lit(1.0 / self.power))

    def slope(self, eta: Column | str) -> Column:
        """Derivative of the inverse."""
        return F.pow(self.inverse(eta), F.lit(1.0 - self.power))

    def capped(self, eta: Column | str, cap: float) -> Column:
        return F.least(_col(eta), F.lit(float(cap)))

    def unclipped(self, eta: Column | str, factor: float) -> Column:
        return self.inverse(eta) * float(factor) - 1.0

    def counts(self, eta: Column | str, factor: float) -> Column:
        return F.greatest(self.unclipped(eta, factor), F.lit(0.0))

    def factor_column(self, eta: Column | str, y: Column | str) -> Column:
        """Aggregate that gives the back-transform factor of the fitting rows."""
        q, y = self.inverse(eta), _col(y).cast("double")
        if self.back == "none":
            return F.max(F.lit(1.0))
        if self.back == "ls":
            return F.sum((y + 1.0) * q) / F.sum(q * q)
        return F.avg(F.exp(self.forward(y) - _col(eta)))

    def factor(self, df: DataFrame, eta: str, y: str) -> float:
        return df.agg(self.factor_column(eta, y).alias("s")).first()["s"]

    # array form, for Arrow batches inside tasks
    def forward_np(self, y: np.ndarray) -> np.ndarray:
        return np.log1p(y) if self.power == 0 else ((y + 1.0) ** self.power - 1.0) / self.power

    def inverse_np(self, eta: np.ndarray) -> np.ndarray:
        if self.power == 0:
            return np.exp(eta)
        return np.maximum(eta * self.power + 1.0, BASE_FLOOR) ** (1.0 / self.power)

    def cap(self, largest: float) -> float:
        """Linear score at which y + 1 is e times the largest fitted y + 1."""
        if self.power == 0:
            return math.log1p(largest) + 1.0
        return ((math.e * (largest + 1.0)) ** self.power - 1.0) / self.power


def usable_backs(power: float, methods=BACK_METHODS) -> list[str]:
    return [m for m in methods if m != "duan" or power == 0]


def sigmoid(eta: Column | str) -> Column:
    """Logistic function that never exponentiates a positive number."""
    eta = _col(eta)
    e = F.exp(-F.abs(eta))
    return F.when(eta >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def linear_score(weights: dict[str, float], intercept: float) -> Column:
    """Intercept plus weighted columns as one expression."""
    out = F.lit(float(intercept))
    for name, w in weights.items():
        out = out + F.col(f"`{name}`") * float(w)
    return out
