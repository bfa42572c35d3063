import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import demand_table
from hourwise.functions import calendar as cal
from hourwise.functions.target import PowerTarget, sigmoid
from hourwise.operators import audit, labels, selection
from hourwise.sources import sinks, tables


def test_csv_round_trip_and_closed_schema(spark, tmp_path):
    pdf = demand_table(days=5)
    path = str(tmp_path / "demand.csv")
    names = [f.name for f in tables.DEMAND_SCHEMA.fields]
    pdf[names].to_csv(path, index=False)
    df = tables.demand_file(spark, path)
    assert df.count() == len(pdf) and dict(df.dtypes)["dteday"] == "date"
    assert df.orderBy("instant").toPandas().hour_idx.tolist() == pdf.hour_idx.tolist()
    other = str(tmp_path / "bad.csv")
    pdf[names].rename(columns={"hum": "humid"}).to_csv(other, index=False)
    with pytest.raises(Exception):
        tables.demand_file(spark, other).collect()
    unlabelled = str(tmp_path / "scoring.csv")
    pdf[names].drop(columns="cnt").to_csv(unlabelled, index=False)
    assert "cnt" not in tables.demand_file(spark, unlabelled, labelled=False).columns


def test_metric_sink_refuses_nan(spark, tmp_path):
    good = spark.createDataFrame([("a", 1.0)], "name string, value double")
    sinks.write_metrics(good, str(tmp_path / "ok"))
    assert sinks.read_model_table(spark, str(tmp_path / "ok"), good.schema).first()["value"] == 1.0
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="NaN or infinity"):
            sinks.write_metrics(spark.createDataFrame([("a", bad)], good.schema), str(tmp_path / "bad"))


def test_missing_cell_fails_and_label_is_strict(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 7)], "g int, cnt int")
    table = labels.fit_thresholds(df.where("g = 1"), ["g"], "cnt", 0.5)
    got = sorted((r["cnt"], r["label"]) for r in labels.apply_thresholds(df.where("g = 1"), table, ["g"], "cnt").collect())
    assert got == [(1, 0), (2, 0), (3, 1)]
    with pytest.raises(Exception, match="no cell"):
        labels.apply_thresholds(df, table, ["g"], "cnt").collect()
    overall = labels.fit_thresholds(df, [], "cnt", 0.5)
    assert overall.first()["threshold"] == 2.5 and overall.first()["n"] == 4


def test_weight_lift_and_difference_errors(spark):
    names = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, name string")
    small = spark.createDataFrame([("b", 2.0)], "name string, weight double")
    assert [r["weight"] for r in audit.lift_by_name(small, names).orderBy("pos").collect()] == [0.0, 2.0]
    with pytest.raises(Exception, match="no place"):
        audit.lift_by_name(spark.createDataFrame([("z", 1.0)], "name string, weight double"), names).collect()
    with pytest.raises(Exception, match="missing"):
        audit.difference_or_fail(names, names.where("pos = 0"), "name").collect()


def test_output_contract_flags(spark):
    want = spark.range(5).withColumnRenamed("id", "k")
    got = spark.createDataFrame([(0, 1.0), (1, -1.0), (2, float("nan")), (2, 3.0), (9, 1.0)], "k long, p double")
    r = audit.output_contract(want, got, "k", "p").first()
    assert (r["n_missing"], r["n_unknown"], r["n_repeated"], r["n_negative"], r["n_not_finite"]) == (2, 1, 1, 1, 1)


@pytest.mark.parametrize("power", [0.0, 0.1, 0.5, 1.0])
def test_target_inverse_cap_and_slope(spark, power):
    t = PowerTarget(power, "none")
    y = np.array([0.0, 1.0, 5.0, 800.0])
    assert np.allclose(t.inverse_np(t.forward_np(y)), y + 1)
    assert t.inverse_np(np.array([t.cap(9.0)]))[0] == pytest.approx(np.e * 10)
    df = spark.createDataFrame(pd.DataFrame({"y": y}))
    got = df.select(t.inverse(t.forward("y")).alias("q"), t.slope(t.forward("y")).alias("d")).toPandas()
    assert np.allclose(got.q, y + 1)
    eta, h = t.forward_np(y), 1e-6
    assert np.allclose(got.d, (t.inverse_np(eta + h) - t.inverse_np(eta - h)) / (2 * h), rtol=1e-4)
    with pytest.raises(ValueError):
        PowerTarget(0.1, "duan")


def test_sigmoid_extremes(spark):
    got = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(sigmoid("x").alias("p")).toPandas().p.tolist()
    assert got == [0.0, 0.5, 1.0]


def test_bin_on_the_lowest_edge_is_null(spark):
    got = spark.createDataFrame([(0.0,), (0.1,), (0.11,), (1.0,)], "x double").select(cal.half_open_bin("x", [0.0, 0.1, 0.2, 1.0]).alias("b"))
    assert [r["b"] for r in got.collect()] == [None, 0, 1, 2]


def test_lineage_by_name(spark):
    names = {"bias": set(), "hr_3*temp": {"hr", "temp"}, "doy_s1": {"dteday"}, "hum^3": {"hum"}, "mn_2*workingday*hr_4": {"mnth", "workingday", "hr"},
             "wslag1_2": {"weathersit"}, "trend": {"dteday"}}
    got = {}
    for r in selection.lineage(spark.createDataFrame([(n,) for n in names], "feature string")).collect():
        got.setdefault(r["feature"], set()).add(r["source"])
    for n, want in names.items():
        assert got.get(n, set()) == want and selection.sources_of(n) == frozenset(want)


def test_verdict_rule_by_hand(spark):
    rows = [("temp", 0.0, -0.1, 0.1, 0.05, 0.01, 0.3, 0.9, "atemp"), ("atemp", 0.0, -0.1, 0.1, 0.05, 0.01, 0.2, 0.9, "temp"),
            ("hr", 0.4, 0.3, 0.5, None, None, 0.4, 0.1, "temp"), ("hum", 0.0005, 0.0001, 0.1, None, None, 0.005, 0.1, "temp"),
            ("windspeed", 0.0, -0.1, 0.1, None, None, 0.02, 0.3, "hum")]
    ev = spark.createDataFrame(rows, "column string, delta double, lo double, hi double, group_delta double, group_lo double, solo_r2 double, max_abs_corr double, corr_with string")
    got = {r["column"]: (r["verdict"], r["representative"], r["carried_by"]) for r in selection.verdicts(ev).collect()}
    assert got == {"temp": ("useful", True, ""), "atemp": ("redundant", False, "temp"), "hr": ("useful", False, ""),
                   "hum": ("uninformative", False, ""), "windspeed": ("redundant", False, "hum")}


def test_checkpoint_folder_is_read_from_the_session(spark):
    from hourwise.session import cut_lineage
    assert cut_lineage(spark.range(10)).count() == 10
