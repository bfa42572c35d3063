import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import EPOCH, demand_table, r2, reference_fit
from hourwise.functions.target import PowerTarget
from hourwise.operators import gram, splits
from hourwise.operators import timeline as tl
from hourwise.plans import curvature as cv
from hourwise.plans import search, solvers
from hourwise.plans.design import Design
from hourwise.plans.lab import Lab, split_key, split_sets, stability, three_validators
from hourwise.plans.spec import ANCHOR, BASE, BLOCKS, DesignSpec, append_blocks, ladder

K = 3
PLAN = ANCHOR.with_blocks("hr_x_hum", "wx_detail", "ws_memory", "wk")
CUT = "2011-09-01"


@pytest.fixture(scope="module")
def table(spark):
    pdf = demand_table(days=60)
    df = tl.weather_memory(spark.createDataFrame(pdf), unique=True)
    df = splits.seeded_split(df, "instant", 3, 0.25).withColumn("late", (F.col("dteday") >= F.lit(CUT).cast("date")).cast("int"))
    folds = splits.day_folds(df.where("val = 0").select("dteday").distinct(), "dteday", K)
    df = df.join(folds, "dteday", "left").cache()
    return df, df.orderBy("instant").toPandas()


@pytest.fixture(scope="module")
def lab(table):
    with Lab(table[0], [PLAN], [0.1, 0.0], EPOCH, split_key("val", "late", "fold"), split_sets(K)) as lab:
        yield lab


def test_three_validators_match_numpy(table, lab):
    pdf = table[1]
    got = three_validators(lab, {"x": (PLAN, 0.1)}, K)[0]
    t = PowerTarget(0.1)

    def score(fit, new):
        return r2(new.cnt, reference_fit(PLAN, fit, new, t)[2])
    assert np.isclose(got["r2"], score(pdf[pdf.val == 0], pdf[pdf.val == 1]), atol=1e-8)
    assert np.isclose(got["chrono_r2"], score(pdf[pdf.late == 0], pdf[pdf.late == 1]), atol=1e-6)
    for g in range(K):
        train = pdf[pdf.val == 0]
        assert np.isclose(got["folds"][g], score(train[train.fold != g], train[train.fold == g]), atol=1e-7)
    assert got["r2"] > 0.6                                          # the planted shape is found


def test_predictions_and_subset_match_numpy(table, lab):
    pdf = table[1]
    names = ["hr_8", "hr_17", "temp", "temp^2", "workingday*hr_8", "hum"]
    m = lab.least_squares("sub", PLAN, "train", 0.1, 1e-8, names)
    lab.learn_factors([m])
    w, s, pred, _, _ = reference_fit(PLAN, pdf[pdf.val == 0], pdf[pdf.val == 1], PowerTarget(0.1), names=names)
    assert np.allclose(m.weights, w, atol=1e-8) and np.isclose(m.factor, s)
    keys = lab.sets["val"]
    got = lab.predict({k: m for k in keys}).toPandas().set_index("id").pred
    assert np.allclose(got[pdf[pdf.val == 1].instant], pred, atol=1e-7)


def test_column_design_equals_the_sums(table, lab):
    df, pdf = table
    spec = DesignSpec(("hum", "temp", "workingday"), ("hum",), 3, ("wx_detail",))
    by_columns = Design(spec, EPOCH).fit(df.where("val = 0"))
    with Lab(df, [spec], [0.1], EPOCH, split_key("val", "late", "fold"), split_sets(K)) as other:
        by_sums = other.design(spec, "train")[0]
    for n in spec.names[1:]:
        assert np.isclose(by_columns.mean[n], by_sums.mean[n], atol=1e-9) and np.isclose(by_columns.std[n], by_sums.std[n], rtol=1e-9)
    assert by_columns.fill == pytest.approx(by_sums.fill)
    z = by_columns.transform(df.where("val = 0"), ("instant",)).orderBy("instant").toPandas()
    fit = pdf[pdf.val == 0]
    X = reference_fit(spec, fit, fit, PowerTarget(0.1))[3]
    assert np.allclose(z[spec.names].to_numpy(), X, atol=1e-9)


def test_fitted_state_ignores_the_rows_scored(table):
    df, _ = table
    spec = DesignSpec(("hum", "temp"), ("temp",), 2)
    changed = df.withColumn("temp", F.when(F.col("val") == 1, 99.0).otherwise(F.col("temp"))).withColumn(
        "cnt", F.when(F.col("val") == 1, F.lit(10 ** 6)).otherwise(F.col("cnt")))
    states = []
    for d in (df, changed):
        with Lab(d, [spec], [0.1], EPOCH, split_key("val", "late", "fold"), split_sets(K)) as lab:
            m = lab.least_squares("m", spec, "train", 0.1)
            lab.learn_factors([m])
            states.append(np.r_[m.weights, m.factor, m.cap, [m.design.mean[n] for n in spec.names[1:]]])
    assert np.allclose(states[0], states[1], rtol=1e-9)


def test_result_does_not_depend_on_partitions(table):
    df, _ = table
    out = []
    for parts in (1, 7):
        with Lab(df.repartition(parts), [ANCHOR], [0.1], EPOCH, split_key("val", "late", "fold"), split_sets(K)) as lab:
            out.append(three_validators(lab, {"x": (ANCHOR, 0.1)}, K)[0])
    assert np.isclose(out[0]["r2"], out[1]["r2"], atol=1e-9) and np.isclose(out[0]["chrono_r2"], out[1]["chrono_r2"], atol=1e-7)


def test_user_columns_and_blocks(table):
    df, pdf = table
    own = {"warm_wet": F.col("temp") * F.col("hum")}
    spec = DesignSpec(("temp",), own=("warm_wet",))
    with Lab(df, [spec], [0.0], EPOCH, split_key("val", "late", "fold"), split_sets(K), own=own) as lab:
        d = lab.design(spec, "all")[0]
    assert d.mean["warm_wet"] == pytest.approx((pdf.temp * pdf.hum).mean())
    with pytest.raises(ValueError):
        DesignSpec(("no_such_column",))
    with pytest.raises(ValueError):
        DesignSpec(blocks=("no_such_block",))


def test_plan_sizes_and_names():
    assert [len(s.names) for _, s in ladder()] == [13, 36, 59, 61, 107, 251, 282, 332, 401, 665, 918]
    assert {b: len(t) for b, t in BLOCKS.items() if b in ("wk_x_hr", "mn_x_hr", "hr_x_ws", "wd_x_wx")} == {"wk_x_hr": 138, "mn_x_hr": 253, "hr_x_ws": 46, "wd_x_wx": 4}
    s = DesignSpec(("temp",), ("hum",), 3, ("wx_detail",))
    assert s.names == ["bias", "temp", "hum", "windspeed", "hum^2", "hum^3", "windspeed^2", "temp*windspeed"]
    assert DesignSpec.from_dict(s.to_dict()) == s
    bigger, added, skipped = append_blocks(s, ["c_atemp", "wx_detail"])
    assert added == ["c_atemp"] and skipped == ["wx_detail"] and "atemp" in bigger.names
    assert len(BASE) == 35


def test_constant_column_gets_deviation_one(table):
    df, _ = table
    d = Design(DesignSpec(("yr", "temp")), EPOCH).fit(df)
    assert d.std["yr"] == 1.0 and d.constants == ["yr"]


def _problem(seed, n=300, p=15, near=False):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p)) + 2.0
    if near:
        X[:, 1] = X[:, 0] + 0.1 * rng.normal(size=n)
    X[:, 4] = 1.0                                                   # constant
    y = X[:, 0] - 2 * X[:, 2] + rng.normal(size=n)
    Xc = X - X.mean(0)
    return Xc.T @ Xc / n, Xc.T @ (y - y.mean()) / n, X, y


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("rho", [1.0, 0.5, 0.1])
def test_elastic_net_meets_optimality(seed, rho):
    G, c, _, _ = _problem(seed, near=seed % 2 == 1)
    alphas = solvers.penalty_grid(solvers.largest_alpha(c, rho), 1e-3, 15)
    W = solvers.penalised_path(G, c, alphas, rho)
    assert not W[0].any()
    for a, w in zip(alphas, W):
        g = c - G @ w - a * (1 - rho) * w
        on = w != 0
        assert np.allclose(g[on], a * rho * np.sign(w[on]), atol=1e-9) and (np.abs(g[~on]) <= a * rho + 1e-9).all()
        assert w[4] == 0.0


def test_ridge_path_and_least_squares():
    G, c, X, y = _problem(0)
    for a, w in zip((10.0, 0.1), solvers.ridge_path(G, c, [10.0, 0.1])):
        assert np.allclose(w, solvers.ridge(G, c, a))
    keep = np.delete(np.arange(15), 4)
    A = np.column_stack([np.ones(300), X[:, keep]])
    w = solvers.least_squares(A.T @ A / 300, A.T @ y / 300, 0.0)
    assert np.allclose(w, np.linalg.lstsq(A, y, rcond=None)[0])
    Z = np.column_stack([np.ones(300), (X[:, keep] - X[:, keep].mean(0)) / X[:, keep].std(0)])
    g = Z.T @ Z / 300
    fit = solvers.descend(g, Z.T @ y / 300, float(y @ y / 300), np.zeros(15), 1.0 / solvers.extreme_eigenvalues(g)[1])
    assert fit["stop"] == "converged" and np.allclose(fit["w"], np.linalg.lstsq(Z, y, rcond=None)[0], atol=1e-4)
    bad = solvers.descend(g, Z.T @ y / 300, float(y @ y / 300), np.zeros(15), 2.1 / solvers.extreme_eigenvalues(g)[1])
    assert bad["stop"] == "diverged"


def test_inflation_of_dependent_columns():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 500))
    corr = np.corrcoef(np.column_stack([a, b, a + b]).T)
    assert solvers.inflation(corr, 0) == 1e6
    assert solvers.inflation(np.corrcoef(a, b), 0) == pytest.approx(1 / (1 - np.corrcoef(a, b)[0, 1] ** 2))


def test_arrow_and_built_in_gram_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    df = spark.createDataFrame([(int(i % 2), *map(float, r), [float(v) for v in r]) for i, r in enumerate(x)],
                               "k int, " + ", ".join(f"c{i} double" for i in range(6)) + ", arr array<double>").repartition(3)
    by_key = gram.array_gram(df, "arr", F.col("k"))
    assert np.allclose(by_key[0][1:, 1:] + by_key[1][1:, 1:], x.T @ x) and by_key[0][0, 0] == 250
    g, c, yy = gram.normal_equations(df, "c5", [f"c{i}" for i in range(5)], 1.0 + F.col("k"))
    w = 1.0 + np.arange(500) % 2
    A = np.column_stack([np.ones(500), x[:, :5]])
    assert np.allclose(g, (A * w[:, None]).T @ A / w.sum()) and np.allclose(c, A.T @ (w * x[:, 5]) / w.sum())


def test_iterative_costs_reach_their_optimum(spark):
    rng = np.random.default_rng(5)
    X = np.column_stack([np.ones(800), rng.normal(size=(800, 3))])
    y = rng.poisson(np.exp(X @ [0.5, 0.4, -0.3, 0.1])).astype(float)
    label = (y > 1).astype(float)
    rows = spark.createDataFrame([([float(v) for v in x], [float(a), float(b)]) for x, a, b in zip(X, y, label)], "x array<double>, ys array<double>").repartition(4).cache()
    t = PowerTarget(0.1, "none")
    objectives = [cv.Objective("p", cv.poisson, np.arange(4), 0, 1e-3), cv.Objective("l", cv.logistic, np.arange(4), 1, 1e-3),
                  cv.Objective("n", cv.log_link_squares, np.arange(4), 0, 1e-4), cv.Objective("k3", cv.UnderPrediction(t, 3.0, t.cap(y.max())), np.arange(4), 0),
                  cv.Objective("k1", cv.UnderPrediction(t, 1.0, t.cap(y.max())), np.arange(4), 0)]
    done = cv.minimise(rows, objectives)
    for o in done:
        target = y if o.label == 0 else label

        def value(w):
            return o.cost(X @ w, target)[0].mean() + 0.5 * o.alpha * (w[1:] ** 2).sum()
        assert o.stop == "converged" and value(o.w) == pytest.approx(o.loss)
        for _ in range(20):
            assert value(o.w + 1e-3 * rng.normal(size=4)) >= o.loss - 1e-10
        slope = o.cost(X @ o.w, target)[1]
        for j in range(4):                                         # finite differences of the stated slope
            step = np.eye(4)[j] * 1e-6
            numeric = (value(o.w + step) - value(o.w - step)) / 2e-6
            assert abs(numeric - (X[:, j] @ slope / 800 + (o.alpha * o.w[j] if j else 0))) < 1e-5
    under = {o.name: float((t.inverse_np(X @ o.w) - 1 < y).mean()) for o in done if o.name.startswith("k")}
    assert under["k3"] < under["k1"]


def test_penalty_search_and_evidence(lab):
    found = search.penalty_search(lab, PLAN, 0.1, K, 6, {"l2": (0.0,), "l1": (1.0,)}, draws=50, seed=1, ratio=1e-2)
    assert {m["method"] for m in found["methods"]} == {"l2", "l1"} and sum(m["recommended"] for m in found["methods"]) == 1
    for m in found["methods"]:
        assert m["val_lo"] < m["val_r2"] < m["val_hi"]
        assert m["val_r2"] == pytest.approx(max(c["val_r2"] for c in found["curves"] if c["method"] == m["method"]))
    rows = {r["column"]: r for r in search.column_evidence(lab, PLAN, 0.1, 0.01, K, 50, 1)}
    assert rows["hr"]["delta"] > 0.1 and rows["hr"]["lo"] > 0 and rows["hr"]["day_delta"] > 0.1
    assert rows["hr"]["group_delta"] is None and rows["workingday"]["group_delta"] >= 0
    freq = {r["feature"]: r["freq"] for r in stability(lab, PLAN, "train", 0.1, 0.02, 1.0, 10, 1).collect()}
    assert freq["temp"] == 1.0 and set(freq) == set(PLAN.names[1:]) and min(freq.values()) < 0.5


def test_stability_equals_refits_on_drawn_days(table, lab):
    """The weighted sums of each draw give the fit of rows repeated by hand."""
    df, pdf = table
    train = pdf[pdf.val == 0]
    _, _, _, X, _ = reference_fit(PLAN, train, train, PowerTarget(0.1))
    days = sorted(train.dteday.unique())
    draws = splits.group_draws(len(days), 3, 1, df.sparkSession).toPandas()
    z = PowerTarget(0.1).forward_np(train.cnt.to_numpy(float))
    hits = np.zeros(X.shape[1] - 1)
    for b in range(3):
        times = dict(zip(draws[draws.b == b].group_no, draws[draws.b == b].times))
        w = np.array([times.get(days.index(d), 0) for d in train.dteday], float)
        g, c = (X * w[:, None]).T @ X / w.sum(), X.T @ (w * z) / w.sum()
        G, cc, _, _ = solvers.centred(g, c)
        hits += np.abs(solvers.elastic_net(G, cc, 0.03, 1.0)) > 1e-10
    got = {r["feature"]: r["freq"] for r in stability(lab, PLAN, "train", 0.1, 0.03, 1.0, 3, 1).collect()}
    assert np.allclose([got[n] for n in PLAN.names[1:]], hits / 3, atol=0.34) and np.mean([abs(got[n] - h / 3) < 1e-9 for n, h in zip(PLAN.names[1:], hits)]) > 0.97


@pytest.mark.parametrize("top", [1e2, 1e6, 1e9])
def test_iterative_costs_recover_weights_at_any_count(spark, top):
    """Two groups whose means are 5 and 8 times `top`."""
    rows = spark.createDataFrame([([1.0, float(i % 2)], [top * (5 if i % 2 == 0 else 8) * (1 + 0.01 * ((i // 2) % 3 - 1))]) for i in range(42)],
                                 "x array<double>, ys array<double>").cache()
    t = PowerTarget(0.0, "none")
    costs = {"p": cv.poisson, "n": cv.log_link_squares, "u": cv.UnderPrediction(t, 1.0, t.cap(8.08 * top))}
    for o in cv.minimise(rows, [cv.Objective(n, c, np.arange(2)) for n, c in costs.items()]):
        plus = 1.0 if o.name == "u" else 0.0
        assert o.stop == "converged" and o.w == pytest.approx([np.log(5 * top + plus), np.log((8 * top + plus) / (5 * top + plus))], abs=1e-6)


def test_fit_that_runs_out_of_steps_says_so(spark):
    rows = spark.createDataFrame([([1.0, float(i % 7)], [float((i * 37) % 11 + i % 7)]) for i in range(60)], "x array<double>, ys array<double>").cache()
    o, = cv.minimise(rows, [cv.Objective("p", cv.poisson, np.arange(2))], max_iter=1)
    assert o.stop == "max_iter" and o.grad_norm > 0


def test_greedy_rule_filters_before_it_picks():
    gains = {"noisy": (0.05, 0.04, 0.0), "sound": (0.01, 0.001, 0.0), "small": (0.0004, 0.0001, 0.0), "drifts": (0.03, 0.001, -0.01)}
    assert search.pick_block(gains, 0.0005, 0.003) == "sound"
    assert search.pick_block({n: gains[n] for n in ("noisy", "small", "drifts")}, 0.0005, 0.003) is None


def test_event_types_get_keys_of_their_own(spark, tmp_path):
    from datetime import datetime
    from hourwise.queries.base import rolled_demand
    kinds = [f"kind{k}" for k in range(12)]
    spark.createDataFrame([(k, datetime(2024, 1, 1, 5), 1, kind, 2.0, "{}") for k, kind in enumerate(kinds)],
                          "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    keys = [r["instant"] for r in rolled_demand(spark, str(tmp_path)).collect()]
    assert len(set(keys)) == 12 and len({k // 100 for k in keys}) == 1


def test_stored_plan_scores_as_the_lab_predicts(spark, table, lab, tmp_path):
    from hourwise.operators import scoring
    df, pdf = table
    m = lab.penalised("stored", PLAN, "train", 0.1, [0.001], 0.0)[0]
    lab.learn_factors([m])
    scoring.store_model(spark, f"{tmp_path}/m", m.design, dict(zip(m.names[1:], m.weights[1:])), m.weights[0], m.target, m.factor, m.cap)
    want = lab.predict({k: m for k in lab.sets["val"]}).toPandas().set_index("id").pred
    got = scoring.score_stored(df.where("val = 1"), f"{tmp_path}/m").toPandas().set_index("instant").pred
    assert len(got) == len(want) and np.allclose(got, want[got.index], rtol=1e-7)
    with pytest.raises(Exception):                       # a plan with memory columns fails where they are missing
        scoring.score_stored(df.drop("ws_lag1"), f"{tmp_path}/m").collect()


def test_gram_in_stripes_equals_one_pass(table, lab, monkeypatch):
    from hourwise.plans import moments
    whole = lab.moments
    width = len(lab.basis.monomials) + 3
    monkeypatch.setattr(moments, "STRIPE_BYTES", 8 * width * lab.classes * 17)          # 17 columns a pass
    monkeypatch.setattr(moments, "EXPANDED_ROWS", 100)
    assert len(moments.stripes(width, lab.classes)) == -(-width // 17)
    for tasks in (lab.tasks, None):                                                     # merged directly, and by a second stage
        again = moments.collect_moments(lab.rows, lab.basis, lab.powers, tasks, lab.classes)
        assert again.keys() == whole.keys()
        for k, m in again.items():
            assert np.allclose(m.products, whole[k].products, rtol=1e-9, atol=1e-9) and m.top == whole[k].top


@pytest.mark.parametrize("rho", [1.0, 0.4])
def test_duality_gap_bounds_the_distance_to_the_optimum(rho):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(300, 15))
    X[:, 3] = X[:, 2] + rng.normal(0, 0.05, 300)
    y = X[:, :4] @ [1.0, -0.5, 0.7, 0.0] + rng.normal(size=300)
    X, y = X - X.mean(0), y - y.mean()
    G, c, square, alpha = X.T @ X / 300, X.T @ y / 300, float(y @ y / 300), 0.1

    def objective(w):
        return 0.5 * np.mean((y - X @ w) ** 2) + alpha * rho * np.abs(w).sum() + alpha * (1 - rho) / 2 * (w @ w)
    fit = solvers.elastic_net_fit(G, c, alpha, rho, label_square=square)
    assert fit["stop"] == "converged" and fit["gap"] < 1e-9
    for w in (np.zeros(15), fit["w"] + rng.normal(0, 0.1, 15), rng.normal(size=15)):
        gap = solvers.duality_gap(G, c, w, alpha, rho, square)
        assert gap >= objective(w) - objective(fit["w"]) - 1e-12 and gap > 0
    assert [f["stop"] for f in solvers.path_fits(G, c, [1.0, 0.1], 0.0)] == ["closed form"] * 2
    assert solvers.elastic_net_fit(np.zeros((2, 2)), np.zeros(2), 0.1, 1.0)["stop"] == "converged"


def test_candidate_plan_has_all_columns():
    from hourwise.queries.models import CANDIDATE_PLAN
    assert len(CANDIDATE_PLAN.names) == 299 and {"yr", "instant", "atemp", "se_2", "mn_12", "wk_6*hr_23"} <= set(CANDIDATE_PLAN.names)
