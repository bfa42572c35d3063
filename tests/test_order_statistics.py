import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hourwise.operators import metrics, ranks, splits
from hourwise.operators.audit import lookup
from hourwise.operators.bootstrap import poisson_weights
from hourwise.operators.numbering import numbered
from hourwise.operators.quantiles import grouped_quantiles, quantiles_of_many_groups


@pytest.fixture(scope="module")
def skewed():
    """One group and one value hold most of the rows."""
    rng = np.random.default_rng(1)
    g = np.where(rng.random(4000) < 0.7, "hot", rng.choice(list("abc"), 4000))
    v = np.where(rng.random(4000) < 0.4, 3.0, np.round(rng.normal(5, 3, 4000), 2))
    return pd.DataFrame({"id": np.arange(4000), "g": g, "v": v})


@pytest.mark.parametrize("buckets", [None, 3, 50])
@pytest.mark.parametrize("parts", [1, 7])
def test_grouped_quantiles_for_any_buckets(spark, skewed, buckets, parts):
    df = spark.createDataFrame(skewed).repartition(parts)
    shares = {"a": 0.1, "m": 0.5, "z": 1.0}
    for found in (quantiles_of_many_groups(df, ["g"], "v", shares, buckets), grouped_quantiles(df, ["g"], "v", shares), grouped_quantiles(df, ["g"], "v", shares, most_groups=2)):
        got = found.toPandas().set_index("g")
        for g, rows in skewed.groupby("g").v:
            assert np.allclose(got.loc[g, ["a", "m", "z"]].astype(float), rows.quantile([0.1, 0.5, 1.0]))
            assert got.loc[g, "n"] == len(rows)


def test_quantiles_narrow_down_on_any_spread(spark, monkeypatch):
    from hourwise.operators import quantiles
    monkeypatch.setattr(quantiles, "COUNTED", 64)                     # few bins a pass, so many passes
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(0, 1, 300), rng.normal(0, 1, 300) * 1e-12, [1e308, -1e308, 5e-324, 0.0, -0.0], np.full(200, 7.25)])
    rows = [("x", float(v)) for v in values] + [("y", 1.5)] + [(None, float(v)) for v in values[:50]] + [("x", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {f"q{i}": i / 20 for i in range(21)}
    got = {r["g"]: r for r in grouped_quantiles(df, ["g"], "v", shares).collect()}
    for g, held in (("x", values), ("y", np.array([1.5])), (None, values[:50])):
        order = np.sort(held)
        for q, share in shares.items():
            at = share * (len(order) - 1)
            low, high = order[int(np.floor(at))], order[int(np.ceil(at))]
            assert got[g][q] == pytest.approx(low + (high - low) * (at - np.floor(at)), rel=1e-12, abs=0)
        assert got[g]["n"] == len(held)
    assert grouped_quantiles(df.limit(0), ["g"], "v", shares).collect() == []
    infinite = spark.createDataFrame([(1.0,), (float("inf"),), (2.0,)], "v double")
    assert grouped_quantiles(infinite, [], "v", {"m": 0.5}).first()["m"] == 2.0


@pytest.mark.parametrize("small", [1000, 2])
def test_a_key_with_most_rows_does_not_go_to_one_task(spark, small):
    rows = spark.range(20_000, numPartitions=8).select("id", F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 70 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"))
    table = spark.createDataFrame([("hot", 1.0), *[(f"k{i}", float(i)) for i in range(6)]], "k string, w double")
    found = lookup(rows, table, ["k"], small=small)
    got = {(r["k"], r["w"]): r["count"] for r in found.groupBy("k", "w").count().collect()}
    assert got[("hot", 1.0)] == 18_000 and sum(got.values()) == 20_000
    assert got[(None, None)] == rows.where("k is null").count() and got.get(("k6", None), 0) == rows.where("k = 'k6'").count()
    per_task = found.where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 3000
    inner = lookup(rows, table, ["k"], "inner", small=small)
    assert inner.count() == rows.where("k is not null and k <> 'k6'").count()


def test_numbers_in_an_order_by_ranges(spark):
    df = spark.range(5000, numPartitions=6).select((F.col("id") * 7919 % 1000).alias("v"), "id").repartition(5, "v")
    got = numbered(df, [F.col("v").desc(), F.col("id")]).collect()
    assert [r["row_no"] for r in sorted(got, key=lambda r: (-r["v"], r["id"]))] == list(range(1, 5001))
    same = numbered(spark.range(400).select(F.lit(1).alias("v")), [F.col("v")], ties=F.xxhash64(F.monotonically_increasing_id()))
    assert sorted(r["row_no"] for r in same.collect()) == list(range(1, 401))
    assert numbered(df.limit(0), [F.col("v")]).collect() == []


def test_global_quantile_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double")
    for buckets in (None, 2, 9):
        assert quantiles_of_many_groups(df, [], "v", {"q": 0.75}, buckets).first()["q"] == 3.0
    assert grouped_quantiles(df, [], "v", {"q": 0.75}).first()["q"] == 3.0


def test_average_ranks_and_running_totals(spark, skewed):
    got = ranks.average_ranks(spark.createDataFrame(skewed), "v").toPandas().set_index("v").avg_rank
    want = skewed.v.rank(method="average").groupby(skewed.v).first()
    assert np.allclose(got.sort_index(), want.sort_index())


@pytest.mark.parametrize("bins", [10, 7])
def test_equal_count_bins_match_array_split(spark, skewed, bins):
    got = ranks.equal_count_bins(spark.createDataFrame(skewed).repartition(5), "v", "id", bins).toPandas().set_index("id").bin
    order = skewed.sort_values(["v", "id"]).id.to_numpy()
    for b, ids in enumerate(np.array_split(order, bins), start=1):
        assert (got[ids] == b).all()


def test_exact_seeded_split(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    one = splits.seeded_split(df.repartition(1), "k", 5, 0.2).where("val = 1").toPandas().k
    many = splits.seeded_split(df.repartition(9), "k", 5, 0.2).where("val = 1").toPandas().k
    assert len(one) == 201 and set(one) == set(many)


def test_auc_and_precision_with_ties(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    p = np.round(rng.random(500) * 0.7 + 0.2 * y, 1)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert np.isclose(metrics.roc_auc(df, "y", "p").first()["auc"], want)
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        ap += (y[hit].sum() / y.sum() - last) * y[hit].mean()
        last = y[hit].sum() / y.sum()
    assert np.isclose(metrics.average_precision(df, "y", "p").first()["pr_auc"], ap)


def test_rates_are_zero_when_a_denominator_is(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.3)], "y int, p double")
    row = metrics.with_rates(df.agg(*[c.alias(n) for n, c in metrics.confusion("y", "p", 0.9).items()])).first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.3), (1, 0.0)], "y int, p double")
    rows = {r["bin"]: r["n"] for r in metrics.calibration(df, "y", "p").collect()}
    assert rows[9] == 1 and rows[0] == 1 and rows[2] == 1 and sum(rows.values()) == 3    # the third edge is just above 0.3


def test_sweep_equals_one_threshold_at_a_time(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"y": rng.integers(0, 2, 300), "p": np.round(rng.random(300), 2)}))
    got = metrics.threshold_sweep(df, "y", "p", [0.25, 0.5, 0.9], 3.0).collect()
    for r in got:
        one = df.agg(*[c.alias(n) for n, c in metrics.confusion("y", "p", r["thr"]).items()]).first()
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (one["tp"], one["fp"], one["tn"], one["fn"])
        assert np.isclose(r["cost"], (3 * one["fn"] + one["fp"]) / 300)


def test_weights_look_like_poisson_one():
    w = poisson_weights(np.arange(20000), 7, np.arange(20))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    shares = [(w == k).mean() for k in range(4)]
    assert np.allclose(shares, [0.3679, 0.3679, 0.1839, 0.0613], atol=0.005)


def test_bootstrap_does_not_depend_on_partitions(spark):
    from hourwise.operators import bootstrap as bt
    rng = np.random.default_rng(0)
    y = rng.normal(size=3000)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(3000), "y": y, "p": y + rng.normal(size=3000) * 0.5}))
    a, b = (bt.interval(bt.r2_of(bt.row_bootstrap_sums(df.repartition(n), "k", "y", ["p"], 100, 3), "p")).first() for n in (1, 7))
    assert np.allclose([a["lo"], a["hi"]], [b["lo"], b["hi"]])
    r = 1 - ((y - df.toPandas().p) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert a["lo"] < r < a["hi"] and 0.01 < a["hi"] - a["lo"] < 0.06


def test_auc_bootstrap_covers_the_estimate(spark):
    from hourwise.operators import bootstrap as bt
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 2000)
    p = np.round(y * 0.3 + rng.random(2000), 3)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    i = bt.interval(bt.auc_bootstrap(df, "y", "p", 100, 3)).first()
    j = bt.interval(bt.auc_bootstrap(df.repartition(5), "y", "p", 100, 3)).first()
    auc = metrics.roc_auc(df, "y", "p").first()["auc"]
    assert i["lo"] < auc < i["hi"] and np.isclose(i["lo"], j["lo"]) and 0.01 < i["hi"] - i["lo"] < 0.08


@pytest.mark.parametrize("mean", [1, 7, 300, 5000, 1 << 21])
def test_poisson_counts_follow_their_mean(mean):
    from hourwise.operators.bootstrap import poisson_counts
    keys, draws = np.arange(200), np.arange(60)
    got = poisson_counts(keys, np.full(200, mean), 5, draws, 60)
    assert abs(got.mean() / mean - 1) < 4 / np.sqrt(mean * got.size) and abs(got.var() / mean - 1) < 0.06
    assert (poisson_counts(keys[50:], np.full(150, mean), 5, draws[7:], 60) == got[50:, 7:]).all()        # by counters alone
    assert (poisson_counts(keys[:3], np.array([0, mean, 0]), 5, draws, 60)[[0, 2]] == 0).all()


def test_many_groups_are_numbered_without_a_window(spark):
    df = spark.range(1_000_000, numPartitions=8).select((F.col("id") * 3).alias("g"))
    got = splits.numbered_groups(df, "g")
    assert got.where(F.col("group_no") * 3 != F.col("g")).count() == 0
    assert got.agg(F.count("*"), F.min("group_no"), F.max("group_no")).first()[:] == (1_000_000, 0, 999_999)
