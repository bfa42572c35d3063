import numpy as np
import pytest
from pyspark.sql import functions as F

from hourwise.operators import trees
from hourwise.plans import protocol
from hourwise.session import leased, release_all, stored


def rows_of(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, n), rng.normal(0, 1, n).round(2), rng.integers(0, 3, n)]).astype(float)
    y = rng.poisson(np.exp(0.3 * x[:, 0] - 0.5 * (x[:, 1] > 0.4) + 0.2 * x[:, 2]))
    return x, y.astype(float)


def frame_of(spark, x, y):
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double").repartition(4)


def brute_scores(model, x, y, rounds, depth, rate, l2, least):
    """The same rule, cut by cut, over rows: best gain of every node among all columns and edges."""
    def slopes(f):
        return {trees.POISSON: (np.exp(f) - y, np.exp(f)), trees.SQUARED: (f - y, np.ones_like(y))}[model.loss]
    f = np.full(len(y), model.first)
    for _ in range(rounds):
        g, h = slopes(f)
        step = np.zeros(len(y))

        def cut(at, level):
            best = None
            for j in range(x.shape[1]):
                for e in model.edges[j]:
                    left = at & (x[:, j] <= e)
                    right = at & (x[:, j] > e)
                    if min(left.sum(), right.sum()) < least:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + l2) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + l2)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, left, right
            if best is None or best[0] <= 1e-9:
                return
            for side in best[1:]:
                step[side] = -rate * g[side].sum() / (h[side].sum() + l2)
                if level + 1 < depth and side.sum() >= 2 * least:
                    cut(side, level + 1)
        cut(np.ones(len(y), bool), 0)
        f = f + step
    return f


@pytest.mark.parametrize("loss", [trees.POISSON, trees.SQUARED])
def test_trees_equal_brute_force_cuts(spark, loss):
    x, y = rows_of()
    df = frame_of(spark, x, y)
    settings = dict(rounds=4, depth=3, rate=0.3, l2=1.0, least_rows=8)
    model = trees.boosted(df, ["a", "b", "c"], "y", loss, bins=24, **settings)
    got = {r["id"]: r["s"] for r in model.predict(df, "s", as_score=True).collect()}
    expected = brute_scores(model, x, y, 4, 3, 0.3, 1.0, 8)
    assert np.allclose([got[i] for i in range(len(y))], expected, atol=1e-9)
    assert model.stop == "rounds" and len(model.trees) == 4


def test_trees_lower_the_loss_and_a_checkpoint_changes_nothing(spark, monkeypatch):
    x, y = rows_of(400, 3)
    df = frame_of(spark, x, y)

    def loss_after(rounds):
        f = np.array([r["s"] for r in trees.boosted(df, ["a", "b", "c"], "y", trees.POISSON, rounds=rounds, depth=2).predict(df, "s", True).orderBy("id").collect()])
        return float(np.mean(np.exp(f) - y * f)), f
    first, _ = loss_after(1)
    last, scores = loss_after(6)
    monkeypatch.setattr(trees, "CUT_ROUNDS", 2)
    assert last < first
    assert np.allclose(loss_after(6)[1], scores)


def test_trees_on_missing_values_constants_and_empty_sides(spark):
    df = spark.createDataFrame([(float(k % 2) if k % 3 else None, 1.0, float(k % 3 == 0)) for k in range(90)], "a double, k double, y double")
    model = trees.boosted(df, ["a", "k"], "y", trees.LOGISTIC, rounds=3, depth=2)
    p = {r["a"]: r["p"] for r in model.predict(df, "p").select("a", "p").distinct().collect()}
    assert p[None] > 0.4 > max(p[0.0], p[1.0])                       # missing is a side of its own
    flat = trees.boosted(df.select("k", "y"), ["k"], "y", trees.SQUARED, rounds=3)
    assert flat.stop == "no cut" and flat.trees == []
    assert model.predict(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        trees.boosted(df.where("y > 5"), ["a"], "y")
    with pytest.raises(ValueError):
        trees.boosted(df, ["a"], "y", bins=999)


def test_sums_of_tasks_may_be_merged_by_a_second_stage(spark, monkeypatch):
    from hourwise.plans import moments
    x, y = rows_of(200, 5)
    df = frame_of(spark, x, y)
    direct = trees.boosted(df, ["a", "b"], "y", trees.POISSON, rounds=2, depth=2)
    monkeypatch.setattr(moments, "DIRECT_BYTES", 0)
    staged = trees.boosted(df, ["a", "b"], "y", trees.POISSON, rounds=2, depth=2)
    assert [t.column for t in direct.trees] == [t.column for t in staged.trees]
    assert np.allclose([v for t in direct.trees for v in t.value], [v for t in staged.trees for v in t.value])


# ----------------------------------------------------------------------------- the protocol

def split_rows(spark, n=300):
    x, y = rows_of(n, 9)
    df = frame_of(spark, x, y)
    return df.withColumns({"val": (F.col("id") % 5 == 0).cast("int"), "late": (F.col("id") > 200).cast("int"), "fold": (F.col("id") % 3).cast("int")})


def mean_fitter(fit, new):
    return new.withColumn("pred", F.lit(fit.agg(F.avg("y")).first()[0]))


def tree_fitter(fit, new):
    return trees.boosted_regression(fit, new, ["a", "b", "c"], "y", rounds=2, depth=2)


def test_every_fitter_sees_the_parts_of_a_hand_made_split(spark):
    df = split_rows(spark).cache()
    done = protocol.predictions(df, {"mean": mean_fitter, "trees": tree_fitter}, protocol.three_parts(3), key="id", label="y")
    got = {(r["fitter"], r["validator"], r["fold"], r["key"]): r["pred"] for r in done.frame.collect()}
    by_hand = {"seeded": [(0, "val = 0", "val = 1")], "days": [(g, f"val = 0 and fold <> {g}", f"val = 0 and fold = {g}") for g in range(3)], "chrono": [(0, "late = 0", "late = 1")]}
    expected = {}
    for validator, parts in by_hand.items():
        for g, fit, held in parts:
            for name, fitter in (("mean", mean_fitter), ("trees", tree_fitter)):
                expected |= {(name, validator, g, r["id"]): r["pred"] for r in fitter(df.where(fit), df.where(held)).collect()}
    assert got.keys() == expected.keys()
    assert np.allclose([got[k] for k in expected], list(expected.values()))
    scores = {r["fitter"]: r for r in protocol.three_scores(done.frame).collect()}
    y = {r["id"]: r["y"] for r in df.collect()}

    def r2(name, validator, g=None):
        held = [(y[k[3]], p) for k, p in expected.items() if k[0] == name and k[1] == validator and g in (None, k[2])]
        a, p = np.array(held).T
        return 1 - ((a - p) ** 2).sum() / ((a - a.mean()) ** 2).sum()
    for name in ("mean", "trees"):
        assert scores[name]["r2"] == pytest.approx(r2(name, "seeded"))
        assert scores[name]["day_r2"] == pytest.approx(np.mean([r2(name, "days", g) for g in range(3)]))
        assert scores[name]["chrono_r2"] == pytest.approx(r2(name, "chrono"))
    versus = protocol.paired(done.frame, "trees", "mean", "days", 200, 1).first()
    assert versus["delta"] == pytest.approx(r2("trees", "days") - r2("mean", "days"))
    assert versus["lo"] < versus["delta"] < versus["hi"]
    same = protocol.paired(done.frame, "mean", "mean", "days", 50, 1).first()
    assert (same["delta"], same["lo"], same["hi"]) == (0, 0, 0)
    done.release()


@pytest.mark.parametrize("bad", [lambda fit, new: new.limit(1).withColumn("pred", F.lit(1.0)), lambda fit, new: new.withColumn("pred", F.lit(None).cast("double")),
                                 lambda fit, new: new.unionAll(new).withColumn("pred", F.lit(1.0)), lambda fit, new: fit.withColumn("pred", F.lit(1.0))])
def test_a_fitter_must_predict_every_row_once(spark, bad):
    with pytest.raises(ValueError, match="exactly one"):
        protocol.predictions(split_rows(spark), {"bad": bad}, protocol.three_parts(3)[:1], key="id", label="y")


# ----------------------------------------------------------------------------- leases

def test_stored_frames_need_nothing_behind_them_and_go_when_released(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b
    source = spark.range(50, numPartitions=3).mapInArrow(count, "id long")
    lease = stored(source, "test")
    assert runs.value == 50
    assert lease.frame.count() == 50 and lease.frame.agg(F.sum("id")).first()[0] == 1225 and runs.value == 50
    at = spark._jvm.org.apache.hadoop.fs.Path(lease.path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(at) and lease.held
    lease.release()
    lease.release()
    assert not files.exists(at) and not lease.held


def test_release_all_unpersists_and_the_next_reader_starts_anew(spark, sf):
    from hourwise.queries.base import demand
    first = demand(spark, sf)
    kept = leased(spark.range(5))
    assert first.storageLevel.useMemory and demand(spark, sf) is first
    assert release_all(spark) >= 2
    assert not first.storageLevel.useMemory and not kept.frame.storageLevel.useMemory
    again = demand(spark, sf)
    assert again is not first and again.storageLevel.useMemory
