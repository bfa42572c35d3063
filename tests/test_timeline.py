import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import demand_table, memory_by_hand
from hourwise.operators import timeline as tl


def _collect(df, *cols):
    return df.orderBy("instant").toPandas()[list(cols)].to_numpy()


def test_memory_matches_lookup_on_every_row(spark):
    pdf = demand_table(days=90)
    df = spark.createDataFrame(pdf)
    lag, wet = memory_by_hand(pdf)
    for unique in (True, False):
        got = _collect(tl.weather_memory(df, unique=unique), "ws_lag1", "wet3")
        assert (got[:, 0] == lag).all() and (got[:, 1] == wet).all()


def test_memory_does_not_read_the_label_or_row_order(spark):
    pdf = demand_table(days=20)
    a = _collect(tl.weather_memory(spark.createDataFrame(pdf)), "ws_lag1", "wet3")
    b = _collect(tl.weather_memory(spark.createDataFrame(pdf.drop(columns="cnt").sample(frac=1, random_state=1)).repartition(7)), "ws_lag1", "wet3")
    assert (a == b).all()


def test_first_row_of_a_repeated_hour_is_the_timeline(spark):
    rows = [(1, 100, 1), (2, 101, 2), (3, 101, 3), (4, 102, 1)]
    df = spark.createDataFrame(rows, "instant long, hour_idx long, weathersit int")
    got = {r["instant"]: r["ws_lag1"] for r in tl.weather_memory(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}


def test_lookup_crosses_block_borders(spark):
    hours = np.arange(tl.BLOCK_HOURS * 3 - 30, tl.BLOCK_HOURS * 3 + 40)
    df = spark.createDataFrame(pd.DataFrame({"hour_idx": hours, "v": hours * 10}))
    got = tl.shifted(df, None, [], {"lag24": ("v", 24), "lead3": ("v", -3)}).toPandas().set_index("hour_idx").sort_index()
    assert len(got) == len(hours)
    known = dict(zip(hours, hours * 10))
    for t in hours:
        assert got.lag24[t] == known.get(t - 24, t * 10) and got.lead3[t] == known.get(t + 3, t * 10)


def test_rolling_extremes_by_hand(spark):
    rng = np.random.default_rng(3)
    hours = np.sort(rng.choice(np.arange(600, 760), 110, replace=False))
    v = rng.integers(0, 5, len(hours))
    df = spark.createDataFrame(pd.DataFrame({"hour_idx": hours, "v": v}))
    got = tl.rolling_extremes(df, [], F.col("v"), 4, True, "m").toPandas().set_index("hour_idx").m
    known = dict(zip(hours, v))
    for t, own in zip(hours, v):
        assert got[t] == max(known.get(t - h, own) for h in range(1, 5))


@pytest.mark.parametrize("seed", range(3))
def test_flag_runs_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    hours = np.sort(rng.choice(np.arange(0, tl.BLOCK_HOURS * 5), 900, replace=False))
    f = (rng.random(900) < 0.9).astype(int)
    f[200:500] = 1                                                 # a run that spans blocks
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "hour_idx": hours, "f": f}))
    want, run = [], 0
    for x in list(f) + [0]:
        if x:
            run += 1
        elif run:
            want.append(run)
            run = 0
    got = sorted(r["n"] for r in tl.flag_runs(df, ["k"], F.col("f") == 1).collect())
    assert got == sorted(want)


def test_key_order_breaks(spark):
    rng = np.random.default_rng(0)
    t = np.arange(500)
    t[[50, 300, 301]] = [10, 5, 4]
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(500), "t": t})).repartition(5)
    row = tl.key_order_breaks(df, "k", "t").first()
    assert row["n_breaks"] == int((np.diff(t) < 0).sum()) and row["monotone"] is False
