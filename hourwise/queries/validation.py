"""Queries: validators, ladders, penalties, selection and refits on the demand table."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hourwise.functions import calendar as cal
from hourwise.functions.target import PowerTarget, linear_score, sigmoid
from hourwise.operators import labels, metrics, scoring, selection, splits, trees
from hourwise.operators.ranks import hash32
from hourwise.plans import curvature as cv
from hourwise.plans import protocol, search, solvers
from hourwise.plans.design import Design
from hourwise.plans.lab import Lab, split_key, split_sets, stability, three_validators
from hourwise.plans.spec import ANCHOR, BASE, HOURS, DesignSpec, ladder
from hourwise.queries.base import EPOCH, FOLDS, SEED, hash_sql, query, rounded
from hourwise.queries.models import (CANDIDATE_PLAN, ONE_PLAN, ONE_SQL, POWER, SMALL_PLAN, TREE_FEATURES, design_rows, fit_objectives, frame, open_lab, result)
from hourwise.session import kept, shared_folder, stored

DRAWS = 1000
_THREE = ("name string, p int, train_r2 double, train_rmse double, r2 double, rmse double, day_r2 double, day_sd double, "
          "chrono_train_r2 double, chrono_r2 double, chrono_rmse double, chrono_mean_ratio double")


def flagship(spark, d):
    """Calendar features fitted before a date, scored on the days after it."""
    with open_lab(spark, d, [DesignSpec(), ANCHOR]) as lab:
        models = [lab.least_squares(n, s, "early", POWER) for n, s in (("base", DesignSpec()), ("anchor", ANCHOR))]
        s = lab.evaluate(models)
        rows = [{"plan": m.name, "side": side, **s.metrics(m.name, side)} for m in models for side in ("early", "late")]
    return result(spark, rows, "plan string, side string, n bigint, r2 double, rmse double, r2_z double, mean_y double, mean_p double, n_clipped bigint")


def _one_lab(spark, d):
    return open_lab(spark, d, [ONE_PLAN], (0.0,))


@query("E2_fit_and_score", f"WITH {ONE_SQL} SELECT CASE WHEN fits THEN 'train' ELSE 'val' END AS side, 2 AS p, round(s, 6) AS factor, n::BIGINT AS n, round(r2, 6) AS r2, "
       "round(rmse, 6) AS rmse, round(r2_z, 6) AS r2_z, round(mean_p, 6) AS mean_p FROM me WHERE m = 'seeded'")
def fit_and_score_one(spark, d):
    """Fit, back-transform factor and scores on both sides and both scales, one column."""
    with _one_lab(spark, d) as lab:
        m = lab.least_squares("one", ONE_PLAN, "train", 0.0, 0.0)
        s = lab.evaluate([m])
        rows = [{"side": side, "p": 2, "factor": m.factor, **s.metrics("one", side)} for side in ("train", "val")]
    return result(spark, rows, "side string, p int, factor double, n bigint, r2 double, rmse double, r2_z double, mean_p double")


@query("E3_day_block_cv", f"WITH {ONE_SQL} SELECT m AS fold, round(r2, 6) AS r2, round(avg(r2) OVER (), 6) AS mean, round(stddev_samp(r2) OVER (), 6) AS sd FROM me "
       "WHERE evals AND m LIKE 'fold%'")
def day_block_cv_one(spark, d):
    """Held-out days, one column: each fold, their mean and spread."""
    with _one_lab(spark, d) as lab:
        r = three_validators(lab, {"one": (ONE_PLAN, 0.0)}, FOLDS, 0.0)[0]
    return result(spark, [{"fold": f"fold{i}", "r2": v, "mean": r["day_r2"], "sd": r["day_sd"]} for i, v in enumerate(r["folds"])], "fold string, r2 double, mean double, sd double")


@query("E4_three_validators", f"""WITH {ONE_SQL} SELECT (SELECT round(r2, 6) FROM me WHERE m = 'seeded' AND fits) AS train_r2, (SELECT round(r2, 6) FROM me WHERE m = 'seeded' AND evals) AS r2,
(SELECT round(avg(r2), 6) FROM me WHERE m LIKE 'fold%' AND evals) AS day_r2, (SELECT round(r2, 6) FROM me WHERE m = 'chrono' AND evals) AS chrono_r2,
(SELECT round(mean_p / mean_y, 6) FROM me WHERE m = 'chrono' AND evals) AS chrono_mean_ratio""")
def validators_one(spark, d):
    """The three validators of a one-column plan."""
    with _one_lab(spark, d) as lab:
        return result(spark, three_validators(lab, {"one": (ONE_PLAN, 0.0)}, FOLDS, 0.0), "train_r2 double, r2 double, day_r2 double, chrono_r2 double, chrono_mean_ratio double")


@query("F6_day_of_month_scores", f"""WITH {ONE_SQL}, h AS (SELECT *, dayofmonth(dteday) = 19 AS held FROM fr), c1 AS (SELECT regr_slope(z, temp) AS w, regr_intercept(z, temp) AS b, ln(1 + max(cnt)) + 1 AS cap FROM h WHERE NOT held),
f1 AS (SELECT sum((cnt + 1) * exp(b + w * temp)) / sum(exp(2 * (b + w * temp))) AS s FROM h, c1 WHERE NOT held)
SELECT count(*)::BIGINT AS n_held, round(1 - sum((cnt - greatest(s * exp(least(b + w * temp, cap)) - 1, 0)) ** 2) / (var_pop(cnt) * count(*)), 6) AS r2 FROM h, c1, f1 WHERE held""")
def day_of_month_scores(spark, d):
    """One day of the month evaluated by a fit on the other days."""
    with Lab(frame(spark, d), [ONE_PLAN], [0.0], EPOCH, (F.dayofmonth("dteday") == 19).cast("int"), {"fit": [0], "held": [1]}) as lab:
        s = lab.evaluate([lab.least_squares("m", ONE_PLAN, "fit", 0.0, 0.0)])
        m = s.metrics("m", "held")
    return result(spark, [{"n_held": m["n"], "r2": m["r2"]}], "n_held bigint, r2 double")


@query("E30_out_of_fold", f"WITH {ONE_SQL} SELECT instant, cnt, CAST(fold AS INTEGER) AS fold, round(p, 6) AS pred FROM pr WHERE evals AND m LIKE 'fold%'")
def out_of_fold_one(spark, d):
    """Every training row scored by the model that did not see its day, one column."""
    with _one_lab(spark, d) as lab:
        models = [lab.least_squares(f"fold{g}", ONE_PLAN, f"fit{g}", 0.0, 0.0) for g in range(FOLDS)]
        lab.learn_factors(models)
        out = stored(lab.predict({k: models[g] for g in range(FOLDS) for k in lab.sets[f"held{g}"]}), "E30").frame
    return rounded(out.select(F.col("id").alias("instant"), F.col("y").cast("bigint").alias("cnt"), (F.col("key") % 10).alias("fold"), "pred"))


@query("E7_learning_curve", f"""WITH {ONE_SQL}, nd AS (SELECT dteday, row_number() OVER (ORDER BY {hash_sql(SEED, 'dteday')}, dteday) AS place, count(*) OVER () AS k FROM td),
sh AS (SELECT unnest([0.2, 0.6, 1.0])::DOUBLE AS fraction), su AS (SELECT fraction, fr.* FROM fr JOIN nd USING (dteday), sh WHERE val = 0 AND place <= greatest(round_even(k * fraction, 0), 1)),
c1 AS (SELECT fraction, regr_slope(z, temp) AS w, regr_intercept(z, temp) AS b, ln(1 + max(cnt)) + 1 AS cap, count(*) AS n FROM su GROUP BY fraction),
f1 AS (SELECT fraction, sum((cnt + 1) * exp(b + w * temp)) / sum(exp(2 * (b + w * temp))) AS s FROM su JOIN c1 USING (fraction) GROUP BY fraction)
SELECT fraction, max(n)::BIGINT AS n_rows, round(1 - sum((cnt - greatest(s * exp(least(b + w * temp, cap)) - 1, 0)) ** 2) / (var_pop(cnt) * count(*)), 6) AS val_r2
FROM fr, c1 JOIN f1 USING (fraction) WHERE val = 1 GROUP BY fraction""")
def learning_curve_one(spark, d):
    """Nested sets of training days, one column."""
    return _learning_curve(spark, d, ONE_PLAN, 0.0, [0.2, 0.6, 1.0], 0.0).select("fraction", "n_rows", "val_r2")


@query("E8_exponent_table", f"""WITH {ONE_SQL}, pw AS (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS l), y AS (SELECT l, fr.*, ((cnt + 1) ** l - 1) / l AS zl FROM fr, pw),
c1 AS (SELECT l, regr_slope(zl, temp) AS w, regr_intercept(zl, temp) AS b, ((exp(1.0::DOUBLE) * (max(cnt) + 1)) ** l - 1) / l AS cap FROM y WHERE val = 0 GROUP BY l),
f1 AS (SELECT l, sum((cnt + 1) * greatest(l * (b + w * temp) + 1, 1e-9) ** (1 / l)) / sum(greatest(l * (b + w * temp) + 1, 1e-9) ** (2 / l)) AS s FROM y JOIN c1 USING (l) WHERE val = 0 GROUP BY l)
SELECT l AS power, round(1 - sum((cnt - greatest(s * greatest(l * least(b + w * temp, cap) + 1, 1e-9) ** (1 / l) - 1, 0)) ** 2) / (var_pop(cnt) * count(*)), 6) AS r2
FROM y JOIN c1 USING (l) JOIN f1 USING (l) WHERE val = 1 GROUP BY l""")
def exponent_table_one(spark, d):
    """Three label exponents from the same sums, one column."""
    powers = (0.1, 0.5, 1.0)
    with open_lab(spark, d, [ONE_PLAN], powers) as lab:
        s = lab.evaluate([lab.least_squares(f"{p:g}", ONE_PLAN, "train", p, 0.0) for p in powers])
        rows = [{"power": p, "r2": s.r2(f"{p:g}", "val")} for p in powers]
    return result(spark, rows, "power double, r2 double")


@query("E11_penalty_curve", f"""WITH {ONE_SQL}, st AS (SELECT avg(temp) AS m, stddev_pop(temp) AS sd, avg(z) AS zm, corr(temp, z) * stddev_pop(z) AS c, ln(1 + max(cnt)) + 1 AS cap FROM fr WHERE val = 0),
al AS (SELECT 'l2' AS method, unnest([1.0, 0.1])::DOUBLE AS alpha UNION ALL SELECT 'l1', unnest([0.1, 0.01])::DOUBLE),
c1 AS (SELECT method, alpha, CASE method WHEN 'l2' THEN c / (1 + alpha) ELSE sign(c) * greatest(abs(c) - alpha, 0) END AS w, st.* FROM al, st),
f1 AS (SELECT method, alpha, sum((cnt + 1) * exp(zm + w * (temp - m) / sd)) / sum(exp(2 * (zm + w * (temp - m) / sd))) AS s FROM fr, c1 WHERE val = 0 GROUP BY method, alpha)
SELECT method, alpha, CAST(max(CASE WHEN abs(w) > 1e-10 THEN 1 ELSE 0 END) AS INTEGER) AS n_nonzero,
round(1 - sum((cnt - greatest(s * exp(least(zm + w * (temp - m) / sd, cap)) - 1, 0)) ** 2) / (var_pop(cnt) * count(*)), 6) AS val_r2
FROM fr, c1 JOIN f1 USING (method, alpha) WHERE val = 1 GROUP BY method, alpha""")
def penalty_curve_one(spark, d):
    """Ridge and lasso penalties scored together, one column."""
    with _one_lab(spark, d) as lab:
        models = [("l2", m) for m in lab.penalised("l2", ONE_PLAN, "train", 0.0, [1.0, 0.1], 0.0)] + [
            ("l1", m) for m in lab.penalised("l1", ONE_PLAN, "train", 0.0, [0.1, 0.01], 1.0)]
        s = lab.evaluate([m for _, m in models])
        rows = [{"method": k, "alpha": m.info["alpha"], "n_nonzero": m.info["n_nonzero"], "val_r2": s.r2(m.name, "val")} for k, m in models]
    return result(spark, rows, "method string, alpha double, n_nonzero int, val_r2 double")


@query("R2_refit_on_all_rows", f"""WITH {ONE_SQL}, st AS (SELECT avg(temp) AS tm, stddev_pop(temp) AS ts FROM fr WHERE val = 0), a AS (SELECT regr_slope(z, temp) AS w, regr_intercept(z, temp) AS b FROM fr WHERE val = 0),
l AS (SELECT regr_slope(z, temp) AS w, regr_intercept(z, temp) AS b FROM fr) SELECT round(a.b + a.w * tm, 6) AS bias_train, round(a.w * ts, 6) AS weight_train, round(l.b + l.w * tm, 6) AS bias_all,
round(l.w * ts, 6) AS weight_all FROM st, a, l""")
def refit_one(spark, d):
    """Weights from the training rows and from all labelled rows on the scaler of the training rows, one column."""
    with _one_lab(spark, d) as lab:
        a = lab.least_squares("a", ONE_PLAN, "train", 0.0, 0.0)
        b = lab.least_squares("b", ONE_PLAN, "train", 0.0, 0.0, rows_of="all")
    rows = [{"bias_train": a.weights[0], "weight_train": a.weights[1], "bias_all": b.weights[0], "weight_all": b.weights[1]}]
    return result(spark, rows, "bias_train double, weight_train double, bias_all double, weight_all double")


@query("E2_fit_and_score_anchor")
def fit_and_score(spark, d):
    """Both sides and both scales of one plan."""
    with open_lab(spark, d, [ANCHOR]) as lab:
        m = lab.least_squares("anchor", ANCHOR, "train", POWER)
        s = lab.evaluate([m])
        rows = [{"side": side, "p": len(ANCHOR.names), "factor": m.factor, **s.metrics("anchor", side)} for side in ("train", "val")]
    return result(spark, rows, "side string, p int, factor double, n bigint, r2 double, rmse double, r2_z double, mean_y double, mean_p double, n_clipped bigint")


@query("E3_day_block_cv_anchor")
def day_block_cv(spark, d):
    """Held-out days: one row per fold with the mean and spread."""
    with open_lab(spark, d, [ANCHOR]) as lab:
        r = three_validators(lab, {"anchor": (ANCHOR, POWER)}, FOLDS)[0]
    return result(spark, [{"fold": i, "r2": v, "mean": r["day_r2"], "sd": r["day_sd"]} for i, v in enumerate(r["folds"])], "fold int, r2 double, mean double, sd double")


@query("E4_three_validators_anchor")
def validators(spark, d):
    """Seeded, held-out-day and chronological scores of one plan."""
    with open_lab(spark, d, [ANCHOR]) as lab:
        return result(spark, three_validators(lab, {"anchor": (ANCHOR, POWER)}, FOLDS), _THREE)


def by_hour(fit, new):
    """A fitter: the mean of the hour, that of all rows for an hour never seen."""
    means = fit.groupBy("hr").agg(F.avg("cnt").alias("_m"))
    return new.join(means, "hr", "left").withColumn("pred", F.coalesce("_m", F.lit(fit.agg(F.avg("cnt")).first()[0])))


def on_temperature(fit, new):
    """A fitter: the log label on one column, with cap and back-transform factor."""
    t = PowerTarget(0.0, "ls")
    row = fit.agg(F.regr_slope(t.forward("cnt"), F.col("temp")).alias("w"), F.regr_intercept(t.forward("cnt"), F.col("temp")).alias("b"), F.max("cnt").alias("top")).first()
    eta = F.col("temp") * row["w"] + row["b"]
    s = t.factor(fit.withColumn("_eta", eta), "_eta", "cnt")
    return new.withColumn("pred", t.counts(t.capped(eta, t.cap(float(row["top"]))), s))


def by_trees(rounds, depth=3):
    """A fitter: boosted trees under the Poisson loss."""
    def fitter(fit, new):
        return trees.boosted_regression(fit, new, TREE_FEATURES, "cnt", rounds=rounds, depth=depth)
    return fitter


@query("E4_fitter_protocol", f"""WITH {ONE_SQL}, bh AS (SELECT m, hr, avg(cnt) AS h FROM role WHERE fits GROUP BY m, hr), bm AS (SELECT m, avg(cnt) AS o FROM role WHERE fits GROUP BY m),
pp AS (SELECT 'by_hour' AS fitter, role.m, cnt, coalesce(h, o) AS p FROM role JOIN bm USING (m) LEFT JOIN bh USING (m, hr) WHERE evals UNION ALL SELECT 'on_temperature', m, cnt, p FROM pr WHERE evals),
sc AS (SELECT fitter, m, 1 - sum((cnt - p) ** 2) / (var_pop(cnt) * count(*)) AS r2, sqrt(avg((cnt - p) ** 2)) AS rmse, avg(p) / avg(cnt) AS ratio FROM pp GROUP BY fitter, m)
SELECT fitter, round(max(r2) FILTER (m = 'seeded'), 6) AS r2, round(max(rmse) FILTER (m = 'seeded'), 6) AS rmse, round(avg(r2) FILTER (m LIKE 'fold%'), 6) AS day_r2,
round(stddev_samp(r2) FILTER (m LIKE 'fold%'), 6) AS day_sd, round(max(r2) FILTER (m = 'chrono'), 6) AS chrono_r2, round(max(ratio) FILTER (m = 'chrono'), 6) AS chrono_mean_ratio FROM sc GROUP BY fitter""")
def fitter_protocol(spark, d):
    """Two user-written models under the three validators."""
    with kept(frame(spark, d)) as df:
        return rounded(protocol.three_scores(protocol.predictions(df, {"by_hour": by_hour, "on_temperature": on_temperature}, protocol.three_parts(FOLDS)).frame))


@query("E4_fitter_protocol_trees")
def fitter_protocol_trees(spark, d):
    """Boosted trees beside the mean of the hour under the three validators, with the paired difference on the seeded side."""
    with kept(frame(spark, d)) as df:
        done = protocol.predictions(df, {"trees": by_trees(5), "by_hour": by_hour}, protocol.three_parts(FOLDS))
        versus = protocol.paired(done.frame, "trees", "by_hour", "seeded", DRAWS, SEED).withColumn("fitter", F.lit("trees"))
        out = protocol.three_scores(done.frame).join(versus, "fitter", "left")
        rows = [r.asDict() for r in out.collect()]
        done.release()
    return result(spark, rows, "fitter string, r2 double, rmse double, day_r2 double, day_sd double, chrono_r2 double, chrono_mean_ratio double, delta double, lo double, hi double")


# two columns have a closed form as well: normal equations of two centred columns

TWO_PLAN, SQUARE_PLAN = DesignSpec(("temp", "windspeed")), DesignSpec(("temp",), ("temp",), 2)


def _two_sql(x: str, tag: str) -> str:
    """Scores of the plan (temp, x) on every part, like those of one column, as the table m{tag}."""
    return f"""x{tag} AS (SELECT *, {x} AS q FROM role),
a{tag} AS (SELECT m, avg(temp) AS mt, avg(q) AS mq, avg(z) AS mz, var_pop(temp) AS tt, var_pop(q) AS qq, covar_pop(temp, q) AS tq, covar_pop(temp, z) AS tz, covar_pop(q, z) AS qz, ln(1 + max(cnt)) + 1 AS cap
  FROM x{tag} WHERE fits GROUP BY m), b{tag} AS (SELECT *, (tz * qq - qz * tq) / (tt * qq - tq * tq) AS wt, (qz * tt - tz * tq) / (tt * qq - tq * tq) AS wq FROM a{tag}),
e{tag} AS (SELECT x{tag}.*, cap, mz + wt * (temp - mt) + wq * (q - mq) AS eta FROM x{tag} JOIN b{tag} USING (m)), f{tag} AS (SELECT m, sum((cnt + 1) * exp(eta)) / sum(exp(2 * eta)) AS s FROM e{tag} WHERE fits GROUP BY m),
p{tag} AS (SELECT e{tag}.*, greatest(s * exp(CASE WHEN fits THEN eta ELSE least(eta, cap) END) - 1, 0) AS p FROM e{tag} JOIN f{tag} USING (m)),
m{tag} AS (SELECT m, fits, evals, 1 - sum((cnt - p) ** 2) / (var_pop(cnt) * count(*)) AS r2, sqrt(avg((cnt - p) ** 2)) AS rmse, avg(p) AS mean_p, avg(cnt) AS mean_y FROM p{tag} WHERE fits OR evals GROUP BY m, fits, evals)"""


def _three_sql(name: str, p: int, scores: str) -> str:
    return f"""SELECT '{name}' AS name, {p} AS p, max(r2) FILTER (m = 'seeded' AND fits) AS train_r2, max(rmse) FILTER (m = 'seeded' AND fits) AS train_rmse, max(r2) FILTER (m = 'seeded' AND evals) AS r2,
max(rmse) FILTER (m = 'seeded' AND evals) AS rmse, avg(r2) FILTER (m LIKE 'fold%' AND evals) AS day_r2, stddev_samp(r2) FILTER (m LIKE 'fold%' AND evals) AS day_sd, max(r2) FILTER (m = 'chrono' AND fits) AS chrono_train_r2,
max(r2) FILTER (m = 'chrono' AND evals) AS chrono_r2, max(rmse) FILTER (m = 'chrono' AND evals) AS chrono_rmse, max(mean_p / mean_y) FILTER (m = 'chrono' AND evals) AS chrono_mean_ratio FROM {scores}"""


_ROUNDED = "name, p, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("train_r2", "train_rmse", "r2", "rmse", "day_r2", "day_sd", "chrono_train_r2", "chrono_r2", "chrono_rmse", "chrono_mean_ratio"))


def _levels(rows: list[dict]) -> list[dict]:
    """Adds the place of each level, the first one within a tolerance of the best and the first over-fit one after it."""
    target = next(i for i, r in enumerate(rows) if r["r2"] >= max(x["r2"] for x in rows) - 0.001)
    over = next((i for i, r in enumerate(rows) if i > target and r["r2"] <= rows[target]["r2"] - 0.005 and r["train_r2"] > rows[target]["train_r2"]), None)
    for i, r in enumerate(rows):
        r["index"], r["is_target"], r["is_overfit"] = i, i == target, i == over
    return rows


@query("E5_complexity_ladder", f"""WITH {ONE_SQL}, {_two_sql('windspeed', 'w')}, l AS ({_three_sql('one', 2, 'me')} UNION ALL {_three_sql('two', 3, 'mw')}), i AS (SELECT *, CAST(p - 2 AS INTEGER) AS index, max(r2) OVER () AS top FROM l),
t AS (SELECT min(index) AS target FROM i WHERE r2 >= top - 0.001) SELECT {_ROUNDED}, index, index = target AS is_target,
index > target AND r2 <= (SELECT r2 FROM i, t WHERE index = target) - 0.005 AND train_r2 > (SELECT train_r2 FROM i, t WHERE index = target) AS is_overfit FROM i, t""")
def ladder_two(spark, d):
    """Two nested plans under three validators, with the picked and the first over-fit level."""
    with open_lab(spark, d, [ONE_PLAN, TWO_PLAN], (0.0,)) as lab:
        rows = three_validators(lab, {"one": (ONE_PLAN, 0.0), "two": (TWO_PLAN, 0.0)}, FOLDS, 0.0)
    return result(spark, _levels(rows), _THREE + ", index int, is_target boolean, is_overfit boolean")


@query("E6_degree_axis", f"WITH {ONE_SQL}, {_two_sql('temp * temp', 'q')}, l AS ({_three_sql('degree1', 2, 'me')} UNION ALL {_three_sql('degree2', 3, 'mq')}) SELECT {_ROUNDED} FROM l")
def degrees_two(spark, d):
    """The power of one column, 1 and 2."""
    with open_lab(spark, d, [ONE_PLAN, SQUARE_PLAN], (0.0,)) as lab:
        return result(spark, three_validators(lab, {"degree1": (ONE_PLAN, 0.0), "degree2": (SQUARE_PLAN, 0.0)}, FOLDS, 0.0), _THREE)


@query("E10_encoding_ablation", f"WITH {ONE_SQL}, {_two_sql('sqrt(temp)', 'u')}, l AS ({_three_sql('linear', 2, 'me')} UNION ALL {_three_sql('with_root', 3, 'mu')}) SELECT {_ROUNDED} FROM l")
def encodings_two(spark, d):
    """A reading alone, and with a user's column of it."""
    both = DesignSpec(("temp",), own=("root_temp",))
    with open_lab(spark, d, [ONE_PLAN, both], (0.0,), own={"root_temp": F.sqrt("temp")}) as lab:
        return result(spark, three_validators(lab, {"linear": (ONE_PLAN, 0.0), "with_root": (both, 0.0)}, FOLDS, 0.0), _THREE)


def _gaps(rows: list[dict]) -> list[dict]:
    """Adds leakage (seeded minus held-out days) and drift (held-out days minus later rows)."""
    return [{**r, "leakage": r["r2"] - r["day_r2"], "drift": r["day_r2"] - r["chrono_r2"]} for r in rows]


@query("E14_gaps", f"""WITH {ONE_SQL}, {_two_sql('windspeed', 'w')}, l AS ({_three_sql('one', 2, 'me')} UNION ALL {_three_sql('two', 3, 'mw')})
SELECT name, round(r2, 6) AS r2, round(day_r2, 6) AS day_r2, round(chrono_r2, 6) AS chrono_r2, round(r2 - day_r2, 6) AS leakage, round(day_r2 - chrono_r2, 6) AS drift FROM l""")
def gaps_two(spark, d):
    """How much of a seeded score leaks from the same days, and how much is lost on later ones."""
    with open_lab(spark, d, [ONE_PLAN, TWO_PLAN], (0.0,)) as lab:
        rows = three_validators(lab, {"one": (ONE_PLAN, 0.0), "two": (TWO_PLAN, 0.0)}, FOLDS, 0.0)
    return result(spark, _gaps(rows), "name string, r2 double, day_r2 double, chrono_r2 double, leakage double, drift double")


@query("E5_complexity_ladder_plan")
def complexity_ladder(spark, d):
    """Eleven nested plans under three validators from one pass of sums, with the picked and the first over-fit level and the gaps."""
    levels = ladder()
    with open_lab(spark, d, [s for _, s in levels]) as lab:
        rows = three_validators(lab, {n: (s, POWER) for n, s in levels}, FOLDS)
    return result(spark, _gaps(_levels(rows)), _THREE + ", index int, is_target boolean, is_overfit boolean, leakage double, drift double")


@query("E6_degree_axis_plan")
def degree_axis(spark, d):
    """Only the power changes."""
    plans = {f"degree{k}": (DesignSpec(BASE, ("temp",), k, ("wd_x_hr",)), POWER) for k in (1, 2, 3, 4, 5, 6, 8)}
    with open_lab(spark, d, [s for s, _ in plans.values()]) as lab:
        return result(spark, three_validators(lab, plans, FOLDS), _THREE)


def _learning_curve(spark, d, plan, power, fractions, alpha=1e-8):
    """Every row class (the first subset that holds its day) is counted once; the subsets are running unions of classes."""
    df = frame(spark, d)
    days = splits.ranked_days(df.where("val = 0"), "dteday", SEED)
    level = F.lit(len(fractions) - 1)
    for i in reversed(range(len(fractions) - 1)):
        level = F.when(F.col("place") <= F.greatest(F.bround(F.col("n_dates") * fractions[i]), F.lit(1)), F.lit(i)).otherwise(level)
    key = F.when(F.col("val") == 1, 1000).otherwise(level)
    sets = {f"part{i}": range(i + 1) for i in range(len(fractions))} | {"val": [1000]}
    with Lab(df.join(days, "dteday", "left"), [plan], [power], EPOCH, key, sets) as lab:
        s = lab.evaluate([lab.least_squares(f"part{i}", plan, f"part{i}", power, alpha) for i in range(len(fractions))])
        rows = [{"fraction": f, "n_rows": s.metrics(f"part{i}", f"part{i}")["n"], "train_r2": s.r2(f"part{i}", f"part{i}"), "val_r2": s.r2(f"part{i}", "val")}
                for i, f in enumerate(fractions)]
    return result(spark, rows, "fraction double, n_rows bigint, train_r2 double, val_r2 double")


@query("E7_learning_curve_anchor")
def learning_curve(spark, d):
    """Nested sets of training days for the anchor plan."""
    return _learning_curve(spark, d, ANCHOR, POWER, [0.1, 0.2, 0.4, 0.6, 0.8, 1.0])


POWERS = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1.0)


@query("E8_exponent_table_anchor")
def exponent_table(spark, d):
    """Eight label exponents as eight right-hand sides of the same sums."""
    with open_lab(spark, d, [ANCHOR], POWERS) as lab:
        rows = three_validators(lab, {f"{p:g}": (ANCHOR, p) for p in POWERS}, FOLDS)
    best = max(r["r2"] for r in rows)
    for r in rows:
        r["best"], r["within_tol"] = r["r2"] == best, r["r2"] >= best - 0.001
    return result(spark, rows, _THREE + ", best boolean, within_tol boolean")


@query("E10_encoding_ablation_plan")
def encoding_ablation(spark, d):
    """Hour dummies against a number and six harmonics, and the plan without its interaction block."""
    rest = tuple(c for c in BASE if c not in HOURS)
    waves = cal.hour_harmonics("hr")
    own = {"hr_num": F.col("hr").cast("double"), **waves}
    plans = {"one_hot": DesignSpec(), "numeric": DesignSpec(rest, own=("hr_num",)), "harmonics": DesignSpec(rest, own=tuple(waves)),
             "with_block": ANCHOR, "without_block": DesignSpec(BASE, ANCHOR.power_cols, ANCHOR.degree)}
    with open_lab(spark, d, list(plans.values()), own=own) as lab:
        return result(spark, three_validators(lab, {n: (s, POWER) for n, s in plans.items()}, FOLDS), _THREE)


def _search(spark, d, lab, n_alphas=40):
    return search.penalty_search(lab, CANDIDATE_PLAN, POWER, FOLDS, n_alphas, {"l2": (0.0,), "l1": (1.0,), "enet": (0.1, 0.3, 0.5, 0.7, 0.9, 0.95)}, draws=DRAWS, seed=SEED, ratio=1e-4)


@query("E11_penalty_curve_anchor")
def penalty_curve(spark, d):
    """Held-out score and non-zero weights per penalty: every penalty of every method scored in one pass."""
    with open_lab(spark, d, [CANDIDATE_PLAN]) as lab:
        models = {}
        for method, rho in (("l2", 0.0), ("enet", 0.5), ("l1", 1.0)):
            grid = search.penalty_grid(lab, CANDIDATE_PLAN, POWER, rho, 40, ratio=1e-3)
            models[method] = lab.penalised(method, CANDIDATE_PLAN, "train", POWER, grid, rho)
        s = lab.evaluate([m for ms in models.values() for m in ms])
        rows = [{"method": k, **m.info, "val_r2": s.r2(m.name, "val"), "train_r2": s.r2(m.name, "train")} for k, ms in models.items() for m in ms]
    return result(spark, rows, "method string, alpha double, n_nonzero int, val_r2 double, train_r2 double, gap double, stop string")


@query("E13_method_comparison")
def method_comparison(spark, d):
    """Ridge, lasso and elastic net at their best penalties, with the recommended one."""
    with open_lab(spark, d, [CANDIDATE_PLAN]) as lab:
        found = _search(spark, d, lab)
    return result(spark, found["methods"], "method string, rho double, alpha double, val_r2 double, val_rmse double, val_lo double, val_hi double, train_r2 double, "
                                           "n_nonzero int, day_r2 double, day_se double, chrono_r2 double, chrono_rmse double, tied boolean, recommended boolean")


@query("E16_cost_shift")
def cost_shift(spark, d):
    """How much of the upward shift comes from fitting counts, and how much from the asymmetric cost."""
    with kept(frame(spark, d).drop("ws_lag1", "wet3")) as df:
        fit = df.where("val = 0")
        m = Design(SMALL_PLAN, EPOCH).fit(fit)
        top = float(fit.agg(F.max("cnt")).first()[0])
        t = PowerTarget(POWER, "none")
        o0, o1, o3 = fit_objectives(
            fit.select(F.array(F.lit(1.0), *m.columns().values()).alias("x"), F.array(t.forward("cnt"), F.col("cnt").cast("double")).alias("ys")),
            [cv.Objective("ls", cv.squared, np.arange(len(SMALL_PLAN.names)), 0)]
            + [cv.Objective(f"k{k}", cv.UnderPrediction(t, float(k), t.cap(top)), np.arange(len(SMALL_PLAN.names)), 1) for k in (1, 3)])
        cols = m.columns()
        z = df.where("val = 1").select("cnt", *[c.alias(f"_x{i}") for i, c in enumerate(cols.values())])
        preds = {o.name: t.counts(linear_score({f"_x{i}": float(w) for i, w in enumerate(o.w[1:])}, float(o.w[0])), 1.0) for o in (o0, o1, o3)}
        cost = {n: F.struct(F.lit(n).alias("model"), F.avg(p).alias("mean_pred"), *[c.alias(k) for k, c in metrics.operator_costs("cnt", p, 3.0).items()],
                            metrics.r2("cnt", p).alias("r2"), metrics.rmse("cnt", p).alias("rmse")) for n, p in preds.items()}
        rows = [r.asDict() for r in z.agg(F.array(*cost.values()).alias("r")).select(F.inline("r")).collect()]
    mean = {r["model"]: r["mean_pred"] for r in rows}
    for r in rows:
        r["stop"] = {o.name: o.stop for o in (o0, o1, o3)}[r["model"]]
        r["shift"] = {"ls": mean["k3"] / mean["ls"], "k1": mean["k1"] / mean["ls"], "k3": mean["k3"] / mean["k1"]}[r["model"]]
    return result(spark, rows, "model string, mean_pred double, sq_cost double, abs_cost double, under_share double, mean_error double, r2 double, rmse double, shift double, stop string", 4)


LOGIT_FULL = DesignSpec(BASE, blocks=("ws_memory",))
_RULES = {"overall": [], "by_entity": ["entity"], "by_entity_daytype": ["entity", "workingday"]}


def _foil_frame(spark, d):
    df = frame(spark, d)
    out = df
    for name, keys in _RULES.items():
        out = labels.apply_thresholds(out, labels.fit_thresholds(df.where("val = 0"), keys, "cnt", 0.75), keys, "cnt", name)
    return out


def _logit_scores(df, m, fitted, label_of):
    """(model, y, p) of the held-out rows under every fitted model, stacked long."""
    cols = m.columns()
    z = df.where("val = 1").select(*set(label_of.values()), F.lit(1.0).alias("_x0"), *[c.alias(f"_x{i}") for i, c in enumerate(cols.values(), start=1)])
    stack = F.array(*[F.struct(F.lit(o.name).alias("model"), F.col(label_of[o.name]).alias("y"),
                               linear_score({f"_x{j}": float(w) for j, w in zip(o.columns, o.w)}, 0.0).alias("eta")) for o in fitted])
    long = z.select(F.explode(stack).alias("r")).select("r.*")
    return long.withColumn("p", sigmoid("eta"))


@query("E25_label_foils")
def label_foils(spark, d):
    """Three label rules times hour-only, trend-only and full models, all nine fitted in the same passes."""
    names = LOGIT_FULL.names
    subsets = {"hour": [0] + [i for i, n in enumerate(names) if n.startswith("hr_")], "trend": [0, names.index("trend")], "full": list(range(len(names)))}
    with kept(_foil_frame(spark, d)) as df:
        fit = df.where("val = 0")
        m = Design(LOGIT_FULL, EPOCH).fit(fit)
        rows = fit.select(F.array(F.lit(1.0), *m.columns().values()).alias("x"), F.array(*[F.col(r).cast("double") for r in _RULES]).alias("ys"))
        objectives = [cv.Objective(f"{r}|{s}", cv.logistic, np.array(c), i, 1e-3) for i, r in enumerate(_RULES) for s, c in subsets.items()]
        fitted = fit_objectives(rows, objectives)
        long = _logit_scores(df, m, fitted, {o.name: o.name.split("|")[0] for o in fitted})
        auc = metrics.roc_auc(long, "y", "p", ["model"])
        acc = long.groupBy("model").agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("accuracy"), F.avg("y").alias("pos_val"))
        out = auc.join(acc, "model").withColumn("majority", F.greatest("pos_val", 1 - F.col("pos_val")))
        stop = {o.name: o.stop for o in fitted}
        return result(spark, [{**r.asDict(), "stop": stop[r["model"]]} for r in out.collect()],
                      "model string, auc double, n_pos bigint, n_neg bigint, accuracy double, pos_val double, majority double, stop string", 4)


@query("E26_l2_sweep")
def l2_sweep(spark, d):
    """Penalties of the logistic model: log-loss and AUC, near ties take the larger penalty."""
    grid = (0.0, 1e-4, 1e-3, 1e-2)
    with kept(_foil_frame(spark, d)) as df:
        fit = df.where("val = 0")
        m = Design(LOGIT_FULL, EPOCH).fit(fit)
        rows = fit.select(F.array(F.lit(1.0), *m.columns().values()).alias("x"), F.array(F.col("by_entity_daytype").cast("double")).alias("ys"))
        cols = np.array([i for i, n in enumerate(LOGIT_FULL.names) if n not in m.constants])
        fitted = fit_objectives(rows, [cv.Objective(f"{l2:g}", cv.logistic, cols, 0, l2) for l2 in grid])
        long = _logit_scores(df, m, fitted, dict.fromkeys([o.name for o in fitted], "by_entity_daytype"))
        auc = {r["model"]: r["auc"] for r in metrics.roc_auc(long, "y", "p", ["model"]).collect()}
        loss = {r["model"]: r["l"] for r in long.groupBy("model").agg(metrics.log_loss("y", "eta").alias("l")).collect()}
    table = [{"l2": float(o.name), "train_loss": o.loss, "val_logloss": loss[o.name], "val_auc": auc[o.name], "steps": o.steps, "stop": o.stop} for o in fitted]
    near = [r["l2"] for r in table if r["val_auc"] >= max(auc.values()) - 1e-4]
    for r in table:
        r["chosen"] = r["l2"] == max(near)
    return result(spark, table, "l2 double, train_loss double, val_logloss double, val_auc double, steps int, stop string, chosen boolean", 4)


def _joined(plan: DesignSpec, extra: DesignSpec) -> DesignSpec:
    return DesignSpec(plan.base, plan.power_cols, plan.degree, plan.blocks + tuple(b for b in extra.blocks if b not in plan.blocks),
                      plan.own + tuple(c for c in extra.own if c not in plan.own))


@query("E27_greedy_blocks")
def greedy_blocks(spark, d):
    """Forward selection over registered blocks and blocks of user columns."""
    own = {"big_day": (F.col("temp") * F.col("hum")), **cal.hinges("dteday", EPOCH, (7, 14)), "root_trend": cal.root_trend("dteday", EPOCH)}
    start = DesignSpec()
    candidates = {"ws_memory": DesignSpec(blocks=("ws_memory",)), "wx_detail": DesignSpec(blocks=("wx_detail",)), "wd_x_hr": DesignSpec(blocks=("wd_x_hr",)),
                  "c_atemp": DesignSpec(blocks=("c_atemp",)), "hinges": DesignSpec(own=("hinge_7", "hinge_14")), "temp_hum": DesignSpec(own=("big_day",)),
                  "root_trend": DesignSpec(own=("root_trend",))}
    everything = start
    for c in candidates.values():
        everything = _joined(everything, c)
    with open_lab(spark, d, [everything], own=own) as lab:
        rows = search.greedy_blocks(lab, start, candidates, POWER, FOLDS, merge=_joined)
    return result(spark, rows, "step int, block string, day_r2 double, chrono_r2 double, gain double, se double, accepted boolean")


@query("E30_out_of_fold_anchor")
def out_of_fold(spark, d):
    """Every training row scored by the model that did not see its day."""
    with open_lab(spark, d, [ANCHOR]) as lab:
        models = [lab.least_squares(f"fold{g}", ANCHOR, f"fit{g}", POWER) for g in range(FOLDS)]
        lab.learn_factors(models)
        by_key = {k: models[g] for g in range(FOLDS) for k in lab.sets[f"held{g}"]}
        out = stored(lab.predict(by_key), "E30").frame
    return rounded(out.select(F.col("id").alias("instant"), F.col("y").cast("bigint").alias("cnt"), (F.col("key") % 10).alias("fold"), "pred"))


@query("E31_stage_summary", f"""WITH {ONE_SQL}, {_two_sql('windspeed', 'w')}, l AS ({_three_sql('one', 2, 'me')} UNION ALL {_three_sql('two', 3, 'mw')})
SELECT name, p, round(train_r2, 6) AS train_r2, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(day_r2, 6) AS day_r2, round(chrono_r2, 6) AS chrono_r2, round(r2 - lag(r2) OVER (ORDER BY p), 6) AS gain FROM l""")
def stages_two(spark, d):
    """One row per stage of two plans, with the gain over the stage before."""
    with open_lab(spark, d, [ONE_PLAN, TWO_PLAN], (0.0,)) as lab:
        rows = three_validators(lab, {"one": (ONE_PLAN, 0.0), "two": (TWO_PLAN, 0.0)}, FOLDS, 0.0)
    for before, r in zip([None, *rows], rows):
        r["gain"] = None if before is None else r["r2"] - before["r2"]
    return result(spark, rows, "name string, p int, train_r2 double, r2 double, rmse double, day_r2 double, chrono_r2 double, gain double")


@query("E31_stage_summary_plan")
def stage_summary(spark, d):
    """One row per modelling stage: settings, size and scores."""
    stages = {"base": (DesignSpec(), POWER), "powers": (DesignSpec(BASE, ("temp",), 3), POWER), "anchor": (ANCHOR, POWER), "candidates": (CANDIDATE_PLAN, POWER)}
    with open_lab(spark, d, [s for s, _ in stages.values()]) as lab:
        rows = three_validators(lab, stages, FOLDS)
    for r in rows:
        spec = stages[r["name"]][0]
        r["settings"] = f"degree={spec.degree} powers={','.join(spec.power_cols) or '-'} blocks={','.join(spec.blocks) or '-'}"
    return result(spark, rows, "name string, settings string, p int, train_r2 double, r2 double, rmse double, day_r2 double, chrono_r2 double")


@query("E32_plan_sweep", f"""WITH {ONE_SQL}, {_two_sql('temp * temp', 'q')}, l AS (SELECT 'degree=1' AS plan, 1 AS degree, 2 AS p, r2 FROM me WHERE m = 'seeded' AND evals UNION ALL SELECT 'degree=2', 2, 3, r2 FROM mq WHERE m = 'seeded' AND evals)
SELECT plan, degree, p, round(r2, 6) AS val_r2, degree = (SELECT min(degree) FROM l WHERE r2 >= (SELECT max(r2) FROM l) - 0.001) AS picked FROM l""")
def sweep_two(spark, d):
    """Two degrees of one column; the smallest within a tolerance wins."""
    plans = {"degree=1": ONE_PLAN, "degree=2": SQUARE_PLAN}
    with open_lab(spark, d, list(plans.values()), (0.0,)) as lab:
        s = lab.evaluate([lab.least_squares(n, p, "train", 0.0, 0.0) for n, p in plans.items()])
        rows = [{"plan": n, "degree": p.degree, "p": len(p.names), "val_r2": s.r2(n, "val")} for n, p in plans.items()]
    pick = search.smallest_within(rows, "val_r2", "degree", 0.001)
    return result(spark, [{**r, "picked": r is pick} for r in rows], "plan string, degree int, p int, val_r2 double, picked boolean")


@query("E32_plan_sweep_plan")
def plan_sweep(spark, d):
    """Degrees, then lists of powered columns; the smallest within a tolerance wins."""
    lists = (("temp",), ("temp", "hum"), ("temp", "hum", "windspeed"))
    first = {f"degree={k}": DesignSpec(BASE, lists[-1] if k > 1 else (), k, ("wd_x_hr",)) for k in (1, 2, 3, 4)}
    second = {f"degree={k} cols={','.join(c)}": DesignSpec(BASE, c, k, ("wd_x_hr",)) for k in (2, 3, 4) for c in lists}
    with open_lab(spark, d, [*first.values(), *second.values()]) as lab:
        models = [lab.least_squares(n, s, "train", POWER) for n, s in {**first, **second}.items()]
        s = lab.evaluate(models)
        rows = [{"plan": n, "sweep": "degree" if n in first else "columns", "degree": spec.degree, "p": len(spec.names), "val_r2": s.r2(n, "val")}
                for n, spec in {**first, **second}.items()]
    pick = search.smallest_within([r for r in rows if r["sweep"] == "degree"], "val_r2", "degree", 0.001)
    options = [r for r in rows if r["sweep"] == "columns" and r["degree"] == pick["degree"]]
    narrow = search.smallest_within(options, "val_r2", "p", 0.001) if options else None
    for r in rows:
        r["picked"] = r is pick or r is narrow
    return result(spark, rows, "plan string, sweep string, degree int, p int, val_r2 double, picked boolean")


@query("E33_penalty_rescue")
def penalty_rescue(spark, d):
    """Does a penalty rescue the largest plan of the ladder? Paired against the anchor."""
    top = ladder()[-1][1]
    with open_lab(spark, d, [top]) as lab:
        reference = lab.least_squares("anchor", ANCHOR, "train", POWER)
        plain = lab.least_squares("unpenalised", top, "train", POWER, search.UNPENALISED)
        curves = {m: lab.penalised(m, top, "train", POWER, search.penalty_grid(lab, top, POWER, rho, 40, ratio=1e-3), rho) for m, rho in (("l2", 0.0), ("l1", 1.0))}
        s = lab.evaluate([reference, plain, *[m for c in curves.values() for m in c]], draws=DRAWS, draw_set="val", seed=SEED)
        rows = [{"method": "unpenalised", "alpha": search.UNPENALISED, "n_nonzero": len(top.names) - 1, "val_r2": s.r2("unpenalised", "val"), **s.paired("unpenalised", "anchor", "val")}]
        for name, c in curves.items():
            i = search.best_of([m.info["alpha"] for m in c], [s.r2(m.name, "val") for m in c])
            rows.append({"method": name, "alpha": c[i].info["alpha"], "n_nonzero": c[i].info["n_nonzero"], "val_r2": s.r2(c[i].name, "val"), **s.paired(c[i].name, "anchor", "val")})
    return result(spark, rows, "method string, alpha double, n_nonzero int, val_r2 double, delta double, lo double, hi double")


# ----------------------------------------------------------------------------- selection

_EVIDENCE = ("column string, delta double, lo double, hi double, day_delta double, group_delta double, group_lo double, group_hi double, solo_r2 double, "
             "max_abs_corr double, corr_with string, vif_max double")


@query("V3_drop_column_cost")
def drop_column_cost(spark, d):
    """Score lost without each original column, alone, with its partners and on held-out days."""
    with open_lab(spark, d, [CANDIDATE_PLAN]) as lab:
        rows = search.column_evidence(lab, CANDIDATE_PLAN, POWER, 0.01, FOLDS, DRAWS, SEED)
    return result(spark, rows, _EVIDENCE)


@query("V4_solo_score", f"""WITH {ONE_SQL}, lg AS (SELECT c, fr.*, CASE c WHEN 'temp' THEN temp ELSE windspeed END AS x FROM fr, (SELECT unnest(['temp', 'windspeed']) AS c)),
st AS (SELECT c, avg(x) AS xm, stddev_pop(x) AS sd, avg(z) AS zm, covar_pop(x, z) / stddev_pop(x) / 1.01::DOUBLE AS w, ln(1 + max(cnt)) + 1 AS cap FROM lg WHERE val = 0 GROUP BY c),
e AS (SELECT lg.*, cap, zm + w * (x - xm) / sd AS eta FROM lg JOIN st USING (c)), f AS (SELECT c, sum((cnt + 1) * exp(eta)) / sum(exp(2 * eta)) AS s FROM e WHERE val = 0 GROUP BY c)
SELECT c AS column, 1 AS n_features, round(1 - sum((cnt - greatest(s * exp(least(eta, cap)) - 1, 0)) ** 2) / (var_pop(cnt) * count(*)), 6) AS solo_r2 FROM e JOIN f USING (c) WHERE val = 1 GROUP BY c""")
def solo_two(spark, d):
    """Score of each of two columns alone, with a small ridge penalty."""
    with open_lab(spark, d, [TWO_PLAN], (0.0,)) as lab:
        models = [lab.penalised(c, TWO_PLAN, "train", 0.0, [0.01], 0.0, [c])[0] for c in TWO_PLAN.names[1:]]
        s = lab.evaluate(models)
        rows = [{"column": m.name.split("|")[0], "n_features": len(m.names) - 1, "solo_r2": s.r2(m.name, "val")} for m in models]
    return result(spark, rows, "column string, n_features int, solo_r2 double")


@query("V4_solo_score_plan")
def solo_score(spark, d):
    """Score of the own features of each original column."""
    names = CANDIDATE_PLAN.names[1:]
    with open_lab(spark, d, [CANDIDATE_PLAN]) as lab:
        own = {c: [n for n in names if selection.sources_of(n) == {c}] for c in selection.ORIGINAL}
        models = [lab.penalised(c, CANDIDATE_PLAN, "train", POWER, [0.01], 0.0, f)[0] for c, f in own.items() if f]
        s = lab.evaluate(models)
        rows = [{"column": m.name.split("|")[0], "n_features": len(m.names) - 1, "solo_r2": s.r2(m.name, "val")} for m in models]
    return result(spark, rows, "column string, n_features int, solo_r2 double")


_STABLE_DRAWS = 50


@query("V6_stability_selection", f"""WITH {ONE_SQL}, st AS (SELECT avg(temp) AS m, stddev_pop(temp) AS sd, abs(covar_pop(temp, z)) / stddev_pop(temp) AS alpha FROM fr WHERE val = 0),
pd AS (SELECT dteday, count(*) AS n, sum((temp - m) / sd) AS sx, sum(((temp - m) / sd) ** 2) AS sxx, sum(z) AS sz, sum((temp - m) / sd * z) AS sxz FROM fr, st WHERE val = 0 GROUP BY dteday),
nd AS (SELECT *, row_number() OVER (ORDER BY dteday) - 1 AS g, count(*) OVER () AS k FROM pd),
dr AS (SELECT b, {hash_sql(SEED, 'b', 'slot')} % (SELECT max(k) FROM nd) AS g FROM (SELECT unnest(range({_STABLE_DRAWS})) AS b), (SELECT unnest(range((SELECT max(k) FROM nd))) AS slot)),
su AS (SELECT b, sum(sxz) / sum(n) - sum(sx) / sum(n) * (sum(sz) / sum(n)) AS c FROM dr JOIN nd USING (g) GROUP BY b)
SELECT 'temp' AS feature, round(avg(CASE WHEN abs(c) - alpha > 1e-10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS freq FROM su, st""")
def stability_one(spark, d):
    """Share of date-bootstrap lasso fits that keep the one column, at the penalty at which all rows would just drop it."""
    with _one_lab(spark, d) as lab:
        _, gram, cross, _ = lab.normal_equations(ONE_PLAN, "train", 0.0)
        alpha = solvers.largest_alpha(solvers.centred(gram, cross)[1], 1.0)
        return result(spark, [r.asDict() for r in stability(lab, ONE_PLAN, "train", 0.0, alpha, 1.0, _STABLE_DRAWS, SEED).collect()], "feature string, freq double")


@query("V6_stability_selection_plan")
def stability_selection(spark, d):
    """Share of date-bootstrap lasso fits that keep each feature; solved on the executors, one task per draw."""
    lab = open_lab(spark, d, [CANDIDATE_PLAN])
    try:
        out = stability(lab, CANDIDATE_PLAN, "train", POWER, 0.02, 1.0, 50, SEED)
        return result(spark, [r.asDict() for r in out.collect()], "feature string, freq double")
    finally:
        lab.close()


def _stable_lasso(lab, names: list[str]) -> list[tuple[str, float, float]]:
    """(feature, weight, freq) of the lasso on these features at the penalty with the best score."""
    grid = search.penalty_grid(lab, CANDIDATE_PLAN, POWER, 1.0, 40, names, ratio=1e-3)
    path = lab.penalised("lasso", CANDIDATE_PLAN, "train", POWER, grid, 1.0, names)
    s = lab.evaluate(path)
    best = path[search.best_of([m.info["alpha"] for m in path], [s.r2(m.name, "val") for m in path])]
    freq = {r["feature"]: r["freq"] for r in stability(lab, CANDIDATE_PLAN, "train", POWER, best.info["alpha"], 1.0, 50, SEED, names).collect()}
    return [(n, float(w), freq[n]) for n, w in zip(best.names[1:], best.weights[1:])]


@query("V8_column_selection")
def column_selection(spark, d):
    """Evidence to verdicts, then lasso and stability on the features of useful columns: what survives."""
    lab = open_lab(spark, d, [CANDIDATE_PLAN])
    try:
        evidence = result(spark, search.column_evidence(lab, CANDIDATE_PLAN, POWER, 0.01, FOLDS, DRAWS, SEED), _EVIDENCE, 12)
        verdict = selection.verdicts(evidence)
        useful = {r["column"] for r in verdict.where("verdict = 'useful'").collect()}
        names = [n for n in CANDIDATE_PLAN.names[1:] if selection.sources_of(n) <= useful]
        chosen = _stable_lasso(lab, names) if names else []          # without a useful column nothing can survive
        stats = spark.createDataFrame(chosen, "feature string, weight double, freq double")
        return rounded(selection.survivors(stats, verdict))
    finally:
        lab.close()


@query("R1_stored_plan_scoring")
def stored_plan_scoring(spark, d):
    """A plan with memory columns fitted on the training side, stored, read back, and applied to the held-out rows in one select."""
    df, path = frame(spark, d), shared_folder(spark, "model")
    with open_lab(spark, d, [MEMORY_PLAN]) as lab:
        stored_model(spark, lab, path)
    return scoring.score_stored(df.where("val = 1"), path).select("instant", F.round("pred", 2).alias("pred"))


MEMORY_PLAN = ANCHOR.with_blocks("ws_memory")


def stored_model(spark, lab, path):
    m = lab.penalised("m", MEMORY_PLAN, "train", POWER, [0.001], 0.0)[0]
    lab.learn_factors([m])
    scoring.store_model(spark, path, m.design, dict(zip(m.names[1:], m.weights[1:])), m.weights[0], m.target, m.factor, m.cap)
    return m


@query("R2_refit_on_all_rows_anchor")
def refit_on_all_rows(spark, d):
    """Same penalty and scaler, weights from training rows and from all labelled rows, and how far their scores are apart."""
    with open_lab(spark, d, [ANCHOR]) as lab:
        a = lab.penalised("a", ANCHOR, "train", POWER, [0.01], 0.0)[0]
        b = lab.penalised("b", ANCHOR, "train", POWER, [0.01], 0.0, rows_of="all")[0]
        s = lab.evaluate([a, b])
        rows = [{"feature": n, "weight_train": float(x), "weight_all": float(y), "factor_train": a.factor, "factor_all": b.factor,
                 "mean_ratio": s.metrics(b.name, "all")["mean_p"] / s.metrics(a.name, "all")["mean_p"]} for n, x, y in zip(a.names, a.weights, b.weights)]
    return result(spark, rows, "feature string, weight_train double, weight_all double, factor_train double, factor_all double, mean_ratio double")
