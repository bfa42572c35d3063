"""Fitted designs: statistics learned on fitting rows, applied to any rows."""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwise.functions import calendar as cal
from hourwise.operators.quantiles import quantile_values
from hourwise.plans.spec import DesignSpec, factors

CONSTANT_STD = 1e-12       # a spread this small is rounding noise of a constant column


def raw_columns(epoch: str, own: dict[str, Column] | None = None) -> dict[str, Column]:
    """Every first-order column as an expression over a demand table (with ws_lag1 and wet3 attached)."""
    ws = cal.merge_top("weathersit", 3)
    number = {n: F.col(n).cast("double") for n in ("workingday", "holiday", "temp", "hum", "windspeed", "atemp", "yr", "instant")}
    return {**cal.one_hot("hr", range(1, 24), "hr_"), **number, **cal.one_hot(ws, (2, 3), "ws_"),
            "trend": cal.linear_trend("dteday", epoch), **cal.year_harmonics("dteday"),
            **cal.one_hot("season", range(2, 5), "se_"), **cal.one_hot("mnth", range(2, 13), "mn_"),
            **cal.one_hot("weekday", range(1, 7), "wk_"), **cal.one_hot("ws_lag1", (2, 3), "wslag1_"),
            **cal.one_hot("wet3", (2, 3), "wet3_"), **(own or {})}


@dataclass
class Design:
    """A plan with its means, standard deviations (population form, 0 becomes 1) and humidity fill."""
    spec: DesignSpec
    epoch: str
    own: dict[str, Column] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    constants: list[str] = field(default_factory=list)
    fill: float | None = None

    def _filled(self) -> dict[str, Column]:
        raw = raw_columns(self.epoch, self.own)
        raw["hum"] = cal.impute_fault("hum", self.fill)
        return raw

    def _z(self, raw: dict[str, Column]) -> dict[str, Column]:
        return {n: (raw[n] - self.mean[n]) / self.std[n] for n in self.spec.first_order}

    def _term(self, name: str, z: dict[str, Column]) -> Column:
        parts = [z[c] if k == 1 else F.pow(z[c], F.lit(float(k))) for c, k in factors(name).items()]
        return reduce(lambda a, b: a * b, parts)

    def _learn(self, df: DataFrame, columns: dict[str, Column], given: dict[str, tuple[float, float]]) -> None:
        fresh = {n: c for n, c in columns.items() if n not in given}
        for n in columns:
            if n in given:
                self.mean[n], self.std[n] = given[n]
        if not fresh:
            return
        named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(fresh.values())])
        row = named.agg(*[f(f"c{i}").alias(f"{t}{i}") for i in range(len(fresh)) for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
        for i, n in enumerate(fresh):
            self.set_stat(n, row[f"m{i}"], row[f"s{i}"])

    def set_stat(self, name: str, mean: float, std: float) -> None:
        if not std > CONSTANT_STD:
            self.constants.append(name)
            std = 1.0
        self.mean[name], self.std[name] = float(mean), float(std)

    def fit(self, df: DataFrame, given: dict | None = None) -> Design:
        """Learn everything on `df`: fill, first-order statistics, then statistics of the derived columns.

        `given` ({'names', 'mean', 'std', 'hum_fill'}) keeps supplied statistics for the names it lists."""
        reuse = {}
        if given:
            reuse = {n: (m, s) for n, m, s in zip(given["names"], given["mean"], given["std"])}
            self.fill = given["hum_fill"]
        else:
            self.fill, = quantile_values(df.where(F.col("hum") > 0), "hum", [0.5])
        raw = self._filled()
        self._learn(df, {n: raw[n] for n in self.spec.first_order}, reuse)
        z = self._z(raw)
        self._learn(df, {n: self._term(n, z) for n in self.spec.derived}, reuse)
        return self

    def columns(self, names: list[str] | None = None) -> dict[str, Column]:
        """Standardised columns by name (all of the plan by default), without the bias."""
        if self.fill is None:
            raise RuntimeError("fit the design first")
        z = self._z(self._filled())
        out = {}
        for n in names if names is not None else self.spec.names[1:]:
            out[n] = z[n] if n in z else (self._term(n, z) - self.mean[n]) / self.std[n]
        return out

    def transform(self, df: DataFrame, keep: tuple[str, ...] = (), names: list[str] | None = None) -> DataFrame:
        return df.select(*keep, F.lit(1.0).alias("bias"), *[c.alias(n) for n, c in self.columns(names).items()])

    def scaler(self) -> dict:
        names = self.spec.names[1:]
        return {"names": names, "mean": [self.mean[n] for n in names], "std": [self.std[n] for n in names], "hum_fill": self.fill}
