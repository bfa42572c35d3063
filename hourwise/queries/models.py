"""Queries: feature plans and model fits."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from hourwise.functions.target import PowerTarget, linear_score
from hourwise.operators import gram as gm
from hourwise.operators import metrics, selection, splits, trees
from hourwise.operators import timeline as tl
from hourwise.operators.ranks import hash32
from hourwise.plans import curvature as cv
from hourwise.plans import solvers
from hourwise.plans.design import Design
from hourwise.plans.lab import Lab, split_key, split_sets
from hourwise.plans.spec import ANCHOR, BASE, DesignSpec, append_blocks, ladder
from hourwise.queries.base import (CUT_DATE, DEMAND, EPOCH, FOLDS, LABELLED, SEED, demand, labelled, query, r6, rounded)
from hourwise.session import kept
from hourwise.sources.tables import table

POWER = 0.1
EARLY = f"dteday < DATE '{CUT_DATE}'"


def frame(spark, folder):
    """Demand rows with the memory columns, the seeded side, the time side and the day fold of the training side."""
    df = tl.weather_memory(labelled(spark, folder), keys=["entity"], unique=True)
    folds = splits.day_folds(df.where("val = 0").select("dteday").distinct(), "dteday", FOLDS)
    return df.join(folds, "dteday", "left")


def open_lab(spark, folder, specs, powers=(POWER,), **kw) -> Lab:
    return Lab(frame(spark, folder), specs, powers, EPOCH, split_key("val", "late", "fold"), split_sets(FOLDS), **kw)


def result(spark, rows: list[dict], schema: str, digits: int = 6):
    """A metric table (a few rows per model) as a DataFrame with rounded doubles."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    plain = [tuple(v.item() if isinstance(v, np.generic) else v for v in (r.get(n) for n in names)) for r in rows]
    return rounded(spark.createDataFrame(plain, schema), digits)


# ----------------------------------------------------------------------------- plans on columns

_STATS = f"""{DEMAND}, fill AS (SELECT quantile_cont(hum, 0.5) AS f FROM demand WHERE hum > 0 AND dteday < DATE '{CUT_DATE}'),
x AS (SELECT *, CASE WHEN hum = 0 THEN f ELSE hum END AS humf, CAST(least(weathersit, 3) = 2 AS INTEGER) AS ws2, CAST(least(weathersit, 3) = 3 AS INTEGER) AS ws3
  FROM demand, fill),
s AS (SELECT avg(temp) AS tm, stddev_pop(temp) AS ts, avg(humf) AS hm, stddev_pop(humf) AS hs, avg(workingday) AS wm, stddev_pop(workingday) AS wsd,
  avg(ws2) AS am, stddev_pop(ws2) AS asd, avg(ws3) AS bm, stddev_pop(ws3) AS bsd, avg(windspeed) AS vm, stddev_pop(windspeed) AS vs
  FROM x WHERE dteday < DATE '{CUT_DATE}'),
z AS (SELECT instant, dteday, (temp - tm) / ts AS temp, (humf - hm) / hs AS hum, (workingday - wm) / wsd AS workingday, (ws2 - am) / asd AS ws_2,
  (ws3 - bm) / bsd AS ws_3, (windspeed - vm) / vs AS windspeed FROM x, s)"""


def _z(*cols):
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in cols)


@query("P19_interaction_products", f"WITH {_STATS} SELECT instant, " + ", ".join(
    f"round(workingday * {c}, 6) + 0.0 AS wd_{c}" for c in ("temp", "hum", "ws_2", "ws_3")) + " FROM z")
def interaction_products(spark, d):
    """Products of standardised columns, statistics from the rows before the cut."""
    df = demand(spark, d)
    m = Design(DesignSpec(("workingday", "temp"), blocks=("wd_x_wx",)), EPOCH).fit(df.where(EARLY))
    z = m.columns(m.spec.first_order)
    return df.select("instant", *[r6(m._term(f"workingday*{c}", z)).alias(f"wd_{c}") for c in ("temp", "hum", "ws_2", "ws_3")])


@query("P20_powers", f"WITH {_STATS} SELECT instant, round(temp * temp, 6) AS temp_2, round(temp ** 3, 6) + 0.0 AS temp_3, round(hum * hum, 6) AS hum_2, "
       "round(hum ** 3, 6) + 0.0 AS hum_3 FROM z")
def powers(spark, d):
    """Powers of standardised columns."""
    df = demand(spark, d)
    m = Design(DesignSpec(("temp", "hum"), ("temp", "hum"), 3), EPOCH).fit(df.where(EARLY))
    z = m.columns(m.spec.first_order)
    return df.select("instant", *[r6(m._term(f"{c}^{k}", z)).alias(f"{c}_{k}") for c in ("temp", "hum") for k in (2, 3)])


@query("P21_standardise", f"WITH {_STATS} SELECT instant, {_z('temp', 'hum', 'workingday', 'windspeed')}, 0.0::DOUBLE AS yr FROM z")
def standardise(spark, d):
    """Mean and population deviation of the fitting rows; a constant column becomes 0."""
    df = demand(spark, d)
    m = Design(DesignSpec(("temp", "hum", "workingday", "windspeed", "yr")), EPOCH).fit(df.where(EARLY))
    return rounded(m.transform(df, ("instant",)).drop("bias"))


@query("P22_two_level_standardise", f"""WITH {_STATS}, d AS (SELECT instant, dteday, temp ** 2 AS a, temp ** 3 AS b, workingday * hum AS c FROM z),
t AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(b) AS bm, stddev_pop(b) AS bsd, avg(c) AS cm, stddev_pop(c) AS csd FROM d WHERE dteday < DATE '{CUT_DATE}')
SELECT instant, round((a - am) / asd, 6) + 0.0 AS temp_2, round((b - bm) / bsd, 6) + 0.0 AS temp_3, round((c - cm) / csd, 6) + 0.0 AS wd_hum FROM d, t""")
def two_level(spark, d):
    """Derived columns standardised once more."""
    df = demand(spark, d)
    m = Design(DesignSpec(("temp", "workingday"), ("temp",), 3, ("wd_x_wx",)), EPOCH).fit(df.where(EARLY))
    out = m.transform(df, ("instant",), ["temp^2", "temp^3", "workingday*hum"])
    return rounded(out.select("instant", F.col("`temp^2`").alias("temp_2"), F.col("`temp^3`").alias("temp_3"), F.col("`workingday*hum`").alias("wd_hum")))


@query("P23_given_scaler", f"""WITH {_STATS}, g AS (SELECT avg(temp) AS gm, stddev_pop(temp) AS gs FROM demand WHERE dteday >= DATE '{CUT_DATE}')
SELECT z.instant, round((demand.temp - gm) / gs, 6) + 0.0 AS temp, round(z.windspeed, 6) + 0.0 AS windspeed FROM z JOIN demand USING (instant), g""")
def given_scaler(spark, d):
    """Supplied statistics for one column, learned ones for the rest."""
    df = demand(spark, d)
    late = Design(DesignSpec(("temp",)), EPOCH).fit(df.where(f"NOT ({EARLY})")).scaler()
    m = Design(DesignSpec(("temp", "windspeed")), EPOCH).fit(df.where(EARLY), late)
    return rounded(m.transform(df, ("instant",)).drop("bias"))


@query("P24_plan_columns", f"""WITH {_STATS}, n AS (SELECT * FROM (VALUES (1, 'workingday'), (2, 'temp'), (3, 'ws_2'), (4, 'ws_3'), (5, 'hum')) t(pos, name))
SELECT CAST(pos AS INTEGER) AS pos, name, round(CASE name WHEN 'workingday' THEN wm WHEN 'temp' THEN tm WHEN 'hum' THEN hm WHEN 'ws_2' THEN am ELSE bm END, 6) AS mean,
round(CASE name WHEN 'workingday' THEN wsd WHEN 'temp' THEN ts WHEN 'hum' THEN hs WHEN 'ws_2' THEN asd ELSE bsd END, 6) AS std FROM n, s""")
def plan_columns(spark, d):
    """Ordered first-order columns of a plan (base first, then what its blocks need) with their learned statistics."""
    df = demand(spark, d)
    spec = DesignSpec(("workingday", "temp"), blocks=("wd_x_wx",))
    m = Design(spec, EPOCH).fit(df.where(EARLY))
    rows = [{"pos": i, "name": n, "mean": m.mean[n], "std": m.std[n]} for i, n in enumerate(spec.first_order, start=1)]
    return result(spark, rows, "pos int, name string, mean double, std double")


@query("P25_column_subset", f"WITH {_STATS} SELECT instant, {_z('hum', 'temp')} FROM z")
def column_subset(spark, d):
    """Some columns of a fitted design, without learning again."""
    df = demand(spark, d)
    m = Design(DesignSpec(("temp", "hum", "workingday")), EPOCH).fit(df.where(EARLY))
    return rounded(m.transform(df, ("instant",), ["hum", "temp"]).drop("bias"))


_FEATURES = f"""{DEMAND}, fx AS (SELECT 'hr_' || hr AS feature, temp, hum FROM demand UNION ALL SELECT 'wk_' || weekday || '*hr_' || hr, temp, hum FROM demand
UNION ALL SELECT 'workingday*hr_' || hr || '*temp', temp, hum FROM demand UNION ALL SELECT 'ws_' || weathersit, temp, hum FROM demand
UNION ALL SELECT 'wet3_' || weathersit || '*trend', temp, hum FROM demand UNION ALL SELECT 'hum^' || weathersit, temp, hum FROM demand),
w AS (SELECT feature, round(avg(temp) * 4 - 1, 9) AS weight, round(avg(CASE WHEN hum > 0.2 THEN 1.0 ELSE 0 END), 9) AS freq FROM fx GROUP BY feature),
parts AS (SELECT feature, split_part(unnest(string_split(feature, '*')), '^', 1) AS p FROM w),
lin AS (SELECT DISTINCT feature, CASE WHEN p = 'trend' THEN 'dteday' WHEN starts_with(p, 'hr_') THEN 'hr' WHEN starts_with(p, 'ws_') OR starts_with(p, 'wet3_')
  OR starts_with(p, 'wslag1_') THEN 'weathersit' WHEN starts_with(p, 'doy_') THEN 'dteday' WHEN starts_with(p, 'se_') THEN 'season' WHEN starts_with(p, 'mn_') THEN 'mnth'
  WHEN starts_with(p, 'wk_') THEN 'weekday' ELSE p END AS source FROM parts)"""


def feature_weights(spark, d):
    """(feature, weight, freq): every feature name the rows produce, with means over the rows behind it."""
    names = F.explode(F.array(
        F.concat(F.lit("hr_"), "hr"), F.concat(F.lit("wk_"), "weekday", F.lit("*hr_"), "hr"),
        F.concat(F.lit("workingday*hr_"), "hr", F.lit("*temp")), F.concat(F.lit("ws_"), "weathersit"),
        F.concat(F.lit("wet3_"), "weathersit", F.lit("*trend")), F.concat(F.lit("hum^"), "weathersit")))
    rows = demand(spark, d).select(names.alias("feature"), "temp", "hum")
    return rows.groupBy("feature").agg(r6(F.avg("temp") * 4 - 1, 9).alias("weight"), r6(F.avg((F.col("hum") > 0.2).cast("double")), 9).alias("freq"))


@query("P26_feature_lineage", f"WITH {_FEATURES} SELECT feature, source, (count(*) OVER (PARTITION BY feature))::BIGINT AS n_sources FROM lin")
def feature_lineage(spark, d):
    """Original columns behind each feature that the table can produce."""
    return selection.lineage(feature_weights(spark, d).select("feature"))


@query("P27_append_blocks", f"""WITH {DEMAND}, n AS (SELECT count(DISTINCT season) AS s, count(DISTINCT mnth) AS m, count(DISTINCT weekday) AS w, count(DISTINCT yr) AS y FROM demand)
SELECT * FROM (SELECT 'c_atemp' AS block, TRUE AS added, 1::BIGINT AS n_new, 1::BIGINT AS n_varying UNION ALL
SELECT 'c_yr', TRUE, 1, CASE WHEN y > 1 THEN 1 ELSE 0 END FROM n UNION ALL
SELECT 'c_season', TRUE, 3, CASE WHEN s > 1 THEN (SELECT count(DISTINCT season) FROM demand WHERE season > 1) ELSE 0 END FROM n UNION ALL
SELECT 'c_weekday', TRUE, 6, CASE WHEN w > 1 THEN (SELECT count(DISTINCT weekday) FROM demand WHERE weekday > 0) ELSE 0 END FROM n UNION ALL
SELECT 'wk', FALSE, 0, 0)""")
def append(spark, d):
    """Candidate blocks added when they bring a column the plan lacks, and how many of their columns vary in the table."""
    spec = DesignSpec(("temp", "workingday"))
    candidates = ["c_atemp", "c_yr", "c_season", "c_weekday", "wk"]
    bigger, added, _ = append_blocks(spec, candidates)
    m = Design(bigger, EPOCH).fit(demand(spark, d))
    rows = []
    for b in candidates:
        new = DesignSpec(("temp",), blocks=(b,)).names[2:] if b in added else []
        rows.append({"block": b, "added": b in added, "n_new": len(new), "n_varying": sum(n not in m.constants for n in new)})
    return result(spark, rows, "block string, added boolean, n_new bigint, n_varying bigint")


# ----------------------------------------------------------------------------- Gram and linear fits on line items

_LI = """li AS (SELECT l_extendedprice / 1000 AS y, l_quantity / 10 AS a, l_discount * 10 AS b, l_tax * 20 AS c, l_returnflag FROM lineitem)"""
_CEN = _LI + """, m AS (SELECT avg(y) AS y0, avg(a) AS a0, avg(b) AS b0 FROM li), k AS (SELECT avg((a - a0) ** 2) AS saa, avg((b - b0) ** 2) AS sbb,
avg((a - a0) * (b - b0)) AS sab, avg((a - a0) * (y - y0)) AS say, avg((b - b0) * (y - y0)) AS sby, max(y0) AS y0, max(a0) AS a0, max(b0) AS b0 FROM li, m)"""


def _solve2(alpha: str, digits: int = 6) -> str:
    det = f"((saa + {alpha}) * (sbb + {alpha}) - sab * sab)"
    wa, wb = f"(say * (sbb + {alpha}) - sby * sab) / {det}", f"(sby * (saa + {alpha}) - say * sab) / {det}"
    return f"round(y0 - a0 * ({wa}) - b0 * ({wb}), {digits}) AS intercept, round({wa}, {digits}) AS w_a, round({wb}, {digits}) AS w_b"


def line_items(spark, d):
    li = table(spark, d, "lineitem", ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return li.select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") / 10).alias("a"), (F.col("l_discount") * 10).alias("b"),
                     (F.col("l_tax") * 20).alias("c"), "l_returnflag")


@query("M1_gram_by_group", f"""WITH {_LI}, l AS (SELECT l_returnflag, unnest(['y', 'a', 'b', 'c']) AS n, unnest([y, a, b, c]) AS v, row_number() OVER () AS r,
unnest([1, 2, 3, 4]) AS p FROM li) SELECT x.l_returnflag, x.n AS a, z.n AS b, round(avg(x.v * z.v), 6) AS value FROM l x JOIN l z ON x.r = z.r AND x.p <= z.p GROUP BY ALL""")
def gram_by_group(spark, d):
    """Mean products of all pairs of columns per group, built-in sums."""
    return rounded(gm.gram_table(line_items(spark, d), {n: F.col(n) for n in ("y", "a", "b", "c")}, ["l_returnflag"]))


@query("M1_gram_of_arrays", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.v * b.v), 6) + 0.0 AS value FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""")
def gram_of_arrays(spark, d):
    """Gram matrix of 64-entry arrays: Arrow partial sums, merged by (group, row), unpacked where they are merged."""
    sums = gm.array_gram_sums(table(spark, d, "embeddings", ["embedding"]), "embedding")

    def unpack(batches):
        import pyarrow as pa
        for b in batches:
            out_i, out_j, out_v = [], [], []
            for i, v in zip(b.column("i").to_pylist(), b.column("v")):
                if i:
                    row = np.frombuffer(v.as_buffer())
                    out_i += [i - 1] * len(row)
                    out_j += range(i - 1, i - 1 + len(row))
                    out_v += row.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out_i, pa.int32()), pa.array(out_j, pa.int32()), pa.array(out_v, pa.float64())], ["i", "j", "value"])

    return rounded(sums.mapInArrow(unpack, "i int, j int, value double"))


@query("M2_least_squares", f"WITH {_CEN} SELECT {_solve2('0.0', 5)} FROM k")
def least_squares(spark, d):
    """Normal equations with a negligible ridge."""
    g, c, _ = gm.normal_equations(line_items(spark, d), "y", ["a", "b"])
    w = solvers.least_squares(g, c)
    return result(spark, [{"intercept": float(w[0]), "w_a": float(w[1]), "w_b": float(w[2])}], "intercept double, w_a double, w_b double", 5)


@query("M3_ridge_path", f"WITH {_CEN}, al AS (SELECT unnest([10.0, 1.0, 0.1, 0.01])::DOUBLE AS alpha) SELECT alpha, {_solve2('alpha')} FROM k, al")
def ridge_path(spark, d):
    """All penalties from one pass and one eigendecomposition."""
    g, c, _ = gm.normal_equations(line_items(spark, d), "y", ["a", "b"])
    G, cc, x, y = solvers.centred(g, c)
    alphas = [10.0, 1.0, 0.1, 0.01]
    rows = [{"alpha": a, "intercept": float(y - x @ w), "w_a": float(w[0]), "w_b": float(w[1])} for a, w in zip(alphas, solvers.ridge_path(G, cc, alphas))]
    return result(spark, rows, "alpha double, intercept double, w_a double, w_b double")


@query("M6_gradient_descent", f"""WITH {_CEN} SELECT round((say * sbb - sby * sab) / (saa * sbb - sab * sab) * sqrt(saa), 6) AS w_a,
round((sby * saa - say * sab) / (saa * sbb - sab * sab) * sqrt(sbb), 6) AS w_b, 'converged' AS stop FROM k""")
def gradient_descent(spark, d):
    """Full-batch descent on standardised columns from zero weights; ends at the least-squares weights."""
    li = line_items(spark, d)
    m = li.agg(*[f(c).alias(f"{t}{c}") for c in ("a", "b") for f, t in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    z = [(F.col(c) - m[f"m{c}"]) / m[f"s{c}"] for c in ("a", "b")]
    g, c, yy = gm.normal_equations(li, "y", z)
    top = solvers.extreme_eigenvalues(g)[1]
    fit = solvers.descend(g, c, yy, np.zeros(3), 0.5 * 2.0 / top, 1e-15, 1e-10)
    return result(spark, [{"w_a": float(fit["w"][1]), "w_b": float(fit["w"][2]), "stop": fit["stop"]}], "w_a double, w_b double, stop string")


_WSUM = _LI + """, v AS (SELECT *, 1 + a AS w FROM li), m AS (SELECT sum(w * y) / sum(w) AS y0, sum(w * a) / sum(w) AS a0, sum(w * b) / sum(w) AS b0 FROM v),
k AS (SELECT sum(w * (a - a0) ** 2) / sum(w) AS saa, sum(w * (b - b0) ** 2) / sum(w) AS sbb, sum(w * (a - a0) * (b - b0)) / sum(w) AS sab,
sum(w * (a - a0) * (y - y0)) / sum(w) AS say, sum(w * (b - b0) * (y - y0)) / sum(w) AS sby, max(y0) AS y0, max(a0) AS a0, max(b0) AS b0 FROM v, m)"""


@query("M11_weighted_least_squares", f"WITH {_WSUM} SELECT {_solve2('0.0', 5)} FROM k")
def weighted_least_squares(spark, d):
    """Rows weighted by a column expression."""
    g, c, _ = gm.normal_equations(line_items(spark, d), "y", ["a", "b"], 1.0 + F.col("a"))
    w = solvers.least_squares(g, c)
    return result(spark, [{"intercept": float(w[0]), "w_a": float(w[1]), "w_b": float(w[2])}], "intercept double, w_a double, w_b double", 5)


@query("M14_condition_number", f"""WITH {_LI}, g AS (SELECT avg(a * a) AS p, avg(b * b) AS q, avg(a * b) AS r FROM li),
e AS (SELECT (p + q) / 2 + sqrt(((p - q) / 2) ** 2 + r * r) AS hi, (p + q) / 2 - sqrt(((p - q) / 2) ** 2 + r * r) AS lo FROM g)
SELECT round(hi, 6) AS lambda_max, round(hi / lo, 6) AS condition FROM e""")
def condition_number(spark, d):
    """Extreme eigenvalues of the mean products."""
    g, _, _ = gm.normal_equations(line_items(spark, d), "y", ["a", "b"])
    lo, hi = solvers.extreme_eigenvalues(g[1:, 1:])
    return result(spark, [{"lambda_max": hi, "condition": hi / lo}], "lambda_max double, condition double")


# One-column plans have closed forms, so SQL can follow fit, factor, cap, clip and score on every split.
ONE_PLAN = DesignSpec(("temp",))
ONE_SQL = f"""{LABELLED}, td AS (SELECT dteday, (dense_rank() OVER (ORDER BY dteday) - 1) % {FOLDS} AS fold FROM (SELECT DISTINCT dteday FROM labelled WHERE val = 0)),
fr AS (SELECT l.*, fold, ln(1 + cnt) AS z FROM labelled l LEFT JOIN td USING (dteday)), ms AS (SELECT unnest(['seeded', 'chrono', {', '.join(f"'fold{g}'" for g in range(FOLDS))}]) AS m),
role AS (SELECT m, fr.*, CASE m WHEN 'seeded' THEN val = 0 WHEN 'chrono' THEN late = 0 ELSE val = 0 AND 'fold' || fold <> m END AS fits,
  CASE m WHEN 'seeded' THEN val = 1 WHEN 'chrono' THEN late = 1 ELSE val = 0 AND 'fold' || fold = m END AS evals FROM fr, ms),
co AS (SELECT m, regr_slope(z, temp) AS w, regr_intercept(z, temp) AS b, ln(1 + max(cnt)) + 1 AS cap FROM role WHERE fits GROUP BY m),
fa AS (SELECT m, sum((cnt + 1) * exp(b + w * temp)) / sum(exp(2 * (b + w * temp))) AS s FROM role JOIN co USING (m) WHERE fits GROUP BY m),
pr AS (SELECT role.*, b + w * temp AS eta, greatest(s * exp(CASE WHEN fits THEN b + w * temp ELSE least(b + w * temp, cap) END) - 1, 0) AS p, s FROM role JOIN co USING (m) JOIN fa USING (m)),
me AS (SELECT m, fits, evals, count(*) AS n, 1 - sum((cnt - p) ** 2) / (var_pop(cnt) * count(*)) AS r2, sqrt(avg((cnt - p) ** 2)) AS rmse,
  1 - sum((z - eta) ** 2) / (var_pop(z) * count(*)) AS r2_z, avg(p) AS mean_p, avg(cnt) AS mean_y, max(s) AS s FROM pr WHERE fits OR evals GROUP BY m, fits, evals)"""

_ETA = f"{DEMAND}, e AS (SELECT *, ln(2 + temp * 4) AS eta FROM demand)"


@query("M16_back_transform_factor", f"""WITH {_ETA} SELECT 1.0::DOUBLE AS none, round(sum((cnt + 1) * exp(eta)) / sum(exp(eta) * exp(eta)), 6) AS ls,
round(avg(exp(ln(1 + cnt) - eta)), 6) AS duan, round(sum(cnt + 1) / sum(exp(eta)), 6) AS ratio FROM e""")
def back_factor(spark, d):
    """Factors that undo the bias of the inverse transform."""
    df = demand(spark, d).withColumn("eta", F.log(F.col("temp") * 4 + 2))
    t = {b: PowerTarget(0.0, b) for b in ("none", "ls", "duan")}
    q = t["ls"].inverse("eta")
    return rounded(df.agg(*[t[b].factor_column("eta", "cnt").alias(b) for b in t], (F.sum(F.col("cnt") + 1) / F.sum(q)).alias("ratio")))


# one column or one 0/1 column has a closed form that SQL can state

_ONE_COL = f"{_LI}, k AS (SELECT var_pop(a) AS g, covar_pop(a, y) AS c FROM li)"


def _one_column(spark, d):
    g, c, _ = gm.normal_equations(line_items(spark, d), "y", ["a"])
    G, cc, _, _ = solvers.centred(g, c)
    return G, cc


@query("M4_elastic_net", f"""WITH {_ONE_COL}, s AS (SELECT unnest([1.0, 1.0, 0.5, 0.5, 0.0])::DOUBLE AS rho, unnest([0.05, 0.5, 0.05, 0.5, 0.5])::DOUBLE AS alpha)
SELECT rho, alpha, round(sign(c) * greatest(abs(c) - alpha * rho, 0) / (g + alpha * (1 - rho)), 6) + 0.0 AS weight, 0.0::DOUBLE AS gap,
CASE WHEN rho = 0 THEN 'closed form' ELSE 'converged' END AS stop FROM k, s""")
def elastic_net_one(spark, d):
    """Lasso, elastic net and ridge of one column: soft threshold over the curvature."""
    G, c = _one_column(spark, d)
    rows = [{"rho": r, "alpha": a, "weight": f["w"][0], **f} for r, a in ((1.0, 0.05), (1.0, 0.5), (0.5, 0.05), (0.5, 0.5), (0.0, 0.5)) for f in solvers.path_fits(G, c, [a], r)]
    return result(spark, rows, "rho double, alpha double, weight double, gap double, stop string")


@query("M5_penalty_path", f"""WITH {_ONE_COL}, s AS (SELECT unnest(range(5)) AS i), p AS (SELECT i, abs(c) * 0.001 ** (i / 4.0::DOUBLE) AS alpha, g, c FROM k, s)
SELECT CAST(i AS INTEGER) AS i, round(alpha, 6) AS alpha, round(sign(c) * greatest(abs(c) - alpha, 0) / g, 6) + 0.0 AS weight,
0.0::DOUBLE AS gap, 'converged' AS stop FROM p""")
def penalty_path_one(spark, d):
    """Penalties from the smallest all-zero one down, and the lasso weight at each."""
    G, c = _one_column(spark, d)
    alphas = solvers.penalty_grid(solvers.largest_alpha(c, 1.0), 1e-3, 5)
    rows = [{"i": i, "alpha": a, "weight": f["w"][0], **f} for i, (a, f) in enumerate(zip(alphas, solvers.path_fits(G, c, alphas, 1.0)))]
    return result(spark, rows, "i int, alpha double, weight double, gap double, stop string")


def _two_groups(rows, cost, alpha=0.0):
    """Weights of a bias and one 0/1 column under a cost."""
    o = fit_objectives(rows, [cv.Objective("m", cost, np.arange(2), alpha=alpha)])[0]
    return [{"bias": o.w[0], "weight": o.w[1], "stop": o.stop}]


@query("M7_logistic", """WITH g AS (SELECT avg(quality) FILTER (n_chars <= 1000) AS p, avg(quality) FILTER (n_chars > 1000) AS q FROM documents JOIN labels USING (doc_id))
SELECT round(ln(p / (1 - p)), 5) AS bias, round(ln(q / (1 - q)) - ln(p / (1 - p)), 5) AS weight, 'converged' AS stop FROM g""")
def logistic_one(spark, d):
    """Logistic regression on one 0/1 column: the log odds of the two groups."""
    df = table(spark, d, "documents", ["doc_id", "n_chars"]).join(table(spark, d, "labels", ["doc_id", "quality"]), "doc_id")
    rows = df.select(F.array(F.lit(1.0), (F.col("n_chars") > 1000).cast("double")).alias("x"), F.array(F.col("quality").cast("double")).alias("ys"))
    return result(spark, _two_groups(rows, cv.logistic), "bias double, weight double, stop string", 5)


_GROUP_MEANS = f"WITH {DEMAND}, g AS (SELECT avg(cnt) FILTER (workingday = 0) AS p, avg(cnt) FILTER (workingday = 1) AS q FROM demand)"


def _by_working_day(spark, d):
    return demand(spark, d).select(F.array(F.lit(1.0), F.col("workingday").cast("double")).alias("x"), F.array(F.col("cnt").cast("double")).alias("ys"))


@query("M8_count_scale_cost", f"{_GROUP_MEANS} SELECT round(ln(1 + p), 4) AS bias, round(ln(1 + q) - ln(1 + p), 4) AS weight, 'converged' AS stop FROM g")
def count_scale_cost(spark, d):
    """The under-prediction cost with ratio 1 on one 0/1 column: the group means on the count scale."""
    t = PowerTarget(0.0, "none")
    largest = float(demand(spark, d).agg(F.max("cnt")).first()[0])
    return result(spark, _two_groups(_by_working_day(spark, d), cv.UnderPrediction(t, 1.0, t.cap(largest))), "bias double, weight double, stop string", 4)


@query("M9_poisson", f"{_GROUP_MEANS} SELECT round(ln(p), 5) AS bias, round(ln(q) - ln(p), 5) AS weight, 'converged' AS stop FROM g")
def poisson_one(spark, d):
    """Poisson regression on one 0/1 column: the log means of the two groups."""
    return result(spark, _two_groups(_by_working_day(spark, d), cv.poisson), "bias double, weight double, stop string", 5)


@query("M10_log_link_squares", f"{_GROUP_MEANS} SELECT round(ln(p), 4) AS bias, round(ln(q) - ln(p), 4) AS weight, 'converged' AS stop FROM g")
def log_link_squares_one(spark, d):
    """Non-linear least squares with a log link on one 0/1 column."""
    return result(spark, _two_groups(_by_working_day(spark, d), cv.log_link_squares), "bias double, weight double, stop string", 4)


# ----------------------------------------------------------------------------- penalised and iterative fits on the demand table

# The level of the ladder that the candidate plan extends, and the blocks held back until then.
TARGET_LEVEL = "C6_weather_detail"
CANDIDATE_BLOCKS = ("c_atemp", "c_yr", "c_instant", "c_season", "c_mnth", "c_weekday")
CANDIDATE_PLAN = append_blocks(dict(ladder())[TARGET_LEVEL], CANDIDATE_BLOCKS)[0]          # 298 columns and the bias


def _candidate_fits(spark, d, alphas, rhos):
    """(rho, alpha, fit, names, violation) of the candidate plan for every ratio and penalty; without alphas 40 from the smallest all-zero one."""
    with open_lab(spark, d, [CANDIDATE_PLAN]) as lab:
        names, gram, cross, _ = lab.normal_equations(CANDIDATE_PLAN, "train", POWER)
        square = lab.sums("train").label_square(POWER) - cross[0] ** 2
    G, c, _, _ = solvers.centred(gram, cross)
    for rho in rhos:
        grid = alphas if alphas is not None else solvers.penalty_grid(solvers.largest_alpha(c, rho), 1e-3, 40)
        for a, fit in zip(grid, solvers.path_fits(G, c, grid, rho, square)):
            yield rho, float(a), fit, names[1:], float(solvers.violation(G, c, fit["w"], float(a), rho))


@query("M4_elastic_net_plan")
def elastic_net(spark, d):
    """Lasso, elastic net and ridge at one penalty, with the duality gap, the largest violation of the conditions and the stop word."""
    rows = [{"rho": rho, "feature": n, "weight": float(v), "violation": bad, **fit} for rho, _, fit, names, bad in _candidate_fits(spark, d, [0.02], (1.0, 0.5, 0.0))
            for n, v in zip(names, fit["w"])]
    return result(spark, rows, "rho double, feature string, weight double, violation double, gap double, stop string")


@query("M5_penalty_path_plan")
def penalty_path(spark, d):
    """Lasso path from the smallest all-zero penalty down: weights per penalty, with their certificate."""
    rows = [{"alpha": a, "feature": n, "weight": float(v), "violation": bad, **fit} for _, a, fit, names, bad in _candidate_fits(spark, d, None, (1.0,))
            for n, v in zip(names, fit["w"])]
    return result(spark, rows, "alpha double, feature string, weight double, violation double, gap double, stop string", 8)


LOGIT_PLAN = DesignSpec(("temp", "hum", "windspeed", "workingday", "ws_2", "ws_3"))


def labelled_scores(spark, d, share=0.75):
    """Training and held-out rows with the high-demand label of each entity."""
    from hourwise.operators import labels
    df = frame(spark, d)
    cells = labels.fit_thresholds(df.where("val = 0"), ["entity", "workingday"], "cnt", share)
    return labels.apply_thresholds(df, cells, ["entity", "workingday"], "cnt")


@query("M7_logistic_plan")
def logistic(spark, d):
    """Logistic regression with an unpenalised bias: the built-in solver and our own passes reach the same optimum."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    l2 = 0.001
    with kept(labelled_scores(spark, d)) as df:
        fit = df.where("val = 0")
        m = Design(LOGIT_PLAN, EPOCH).fit(fit)
        z = m.transform(fit, ("label",))
        vec = VectorAssembler(inputCols=LOGIT_PLAN.first_order, outputCol="features").transform(z)
        built_in = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(vec)
        own = fit_objectives(z.select(F.array("bias", *LOGIT_PLAN.first_order).alias("x"), F.array(F.col("label").cast("double")).alias("ys")),
                             [cv.Objective("logit", cv.logistic, np.arange(len(LOGIT_PLAN.names)), alpha=l2)])[0]
    rows = [{"feature": n, "weight": float(v), "own": float(o), "stop": own.stop} for n, v, o in
            zip(LOGIT_PLAN.names, [built_in.intercept, *built_in.coefficients.toArray()], own.w)]
    return result(spark, rows, "feature string, weight double, own double, stop string", 5)


def fit_objectives(rows, objectives, **kw):
    with kept(rows) as r:
        return cv.minimise(r, objectives, **kw)


def design_rows(df, m: Design, label: str = "cnt"):
    """(x with the bias first, ys) of a fitted design."""
    cols = m.columns()
    return df.select(F.array(F.lit(1.0), *cols.values()).alias("x"), F.array(F.col(label).cast("double")).alias("ys"))


SMALL_PLAN = DesignSpec(("temp", "hum", "windspeed", "workingday", "ws_2", "ws_3", "trend"), ("temp",), 2)


@query("M8_asymmetric_cost_plan")
def asymmetric_cost(spark, d):
    """Squared cost with under-predictions three times as dear, from the least-squares start; k = 1 beside it."""
    with kept(labelled(spark, d)) as df:
        fit = df.where("val = 0")
        m = Design(SMALL_PLAN, EPOCH).fit(fit)
        top = float(fit.agg(F.max("cnt")).first()[0])
        t = PowerTarget(POWER, "none")
        g, c, _ = gm.normal_equations(fit.select(t.forward("cnt").alias("z"), *[x.alias(f"x{i}") for i, x in enumerate(m.columns().values())]), "z",
                                      [f"x{i}" for i in range(len(m.columns()))])
        start = solvers.least_squares(g, c)
        names = SMALL_PLAN.names
        found = fit_objectives(design_rows(fit, m), [cv.Objective(f"k{k}", cv.UnderPrediction(t, float(k), t.cap(top)), np.arange(len(names)), start=start)
                                                     for k in (1, 3)])
    rows = [{"cost": o.name, "feature": n, "weight": float(v), "loss": o.loss, "stop": o.stop} for o in found for n, v in zip(names, o.w)]
    return result(spark, rows, "cost string, feature string, weight double, loss double, stop string", 4)


@query("M9_poisson_plan")
def poisson(spark, d):
    """Poisson regression with a log link: own passes beside the built-in family with its penalty rescaled."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    alpha = 1e-3
    with kept(labelled(spark, d)) as df:
        fit = df.where("val = 0")
        m = Design(SMALL_PLAN, EPOCH).fit(fit)
        own = fit_objectives(design_rows(fit, m), [cv.Objective("poisson", cv.poisson, np.arange(len(SMALL_PLAN.names)), alpha=alpha)])[0]
        z = m.transform(fit, ("cnt",))
        plain = z.select("cnt", *[F.col(f"`{n}`").alias(f"x{i}") for i, n in enumerate(SMALL_PLAN.names[1:])])
        vec = VectorAssembler(inputCols=plain.columns[1:], outputCol="features").transform(plain)
        mean = fit.agg(F.avg("cnt")).first()[0]
        glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol="cnt", regParam=alpha / mean, tol=1e-12, maxIter=100).fit(vec)
    rows = [{"feature": n, "weight": float(v), "built_in": float(b), "stop": own.stop} for n, v, b in zip(SMALL_PLAN.names, own.w, [glm.intercept, *glm.coefficients.toArray()])]
    return result(spark, rows, "feature string, weight double, built_in double, stop string", 4)


@query("M10_log_link_squares_plan")
def log_link_squares(spark, d):
    """Non-linear least squares with a log link."""
    with kept(labelled(spark, d)) as df:
        fit = df.where("val = 0")
        m = Design(SMALL_PLAN, EPOCH).fit(fit)
        o = fit_objectives(design_rows(fit, m), [cv.Objective("nls", cv.log_link_squares, np.arange(len(SMALL_PLAN.names)), alpha=1e-4)])[0]
    rows = [{"feature": n, "weight": float(v), "loss": o.loss, "stop": o.stop} for n, v in zip(SMALL_PLAN.names, o.w)]
    return result(spark, rows, "feature string, weight double, loss double, stop string", 4)


TREE_FEATURES = ["hr", "weekday", "workingday", "weathersit", "temp", "hum", "windspeed"]


# a tree of depth 1 on the hour has a closed form: cuts of a histogram
_HOUR_CUT = """c AS (SELECT hr, sum(g) OVER (ORDER BY hr) AS gl, sum(h) OVER (ORDER BY hr) AS hl, sum(n) OVER (ORDER BY hr) AS nl, sum(g) OVER () AS ga, sum(h) OVER () AS ha, sum(n) OVER () AS na FROM hh),
best AS (SELECT *, -0.1::DOUBLE * gl / (hl + 1) AS low, -0.1::DOUBLE * (ga - gl) / (ha - hl + 1) AS high FROM c WHERE nl >= 10 AND na - nl >= 10
  ORDER BY gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) DESC, hr LIMIT 1)"""
_STUMP = {"rounds": 1, "depth": 1, "rate": 0.1}
TREE_ROUNDS = 20             # rounds of the registered full fits; each costs `depth` passes


@query("M12_boosted_trees", f"""WITH {LABELLED}, t AS (SELECT CAST(sum(cnt) AS DOUBLE) / count(*) AS m FROM labelled WHERE val = 0),
hh AS (SELECT hr, count(*) * m - sum(cnt) AS g, count(*) * m AS h, count(*) AS n FROM labelled, t WHERE val = 0 GROUP BY hr, m), {_HOUR_CUT}
SELECT instant, round(exp(ln(m) + CASE WHEN l.hr <= b.hr THEN low ELSE high END), 6) AS pred FROM labelled l, t, best b WHERE val = 1""")
def boosted_stump(spark, d):
    """One round of one cut on the hour under the Poisson loss."""
    df = labelled(spark, d)
    return rounded(trees.boosted_regression(df.where("val = 0"), df.where("val = 1"), ["hr"], "cnt", **_STUMP).select("instant", "pred"))


@query("M12_boosted_trees_plan")
def boosted_trees(spark, d):
    """Poisson trees for the count and logistic trees for the high-demand label, scored on the held-out side."""
    with kept(labelled_scores(spark, d)) as df:
        fit, new = df.where("val = 0"), df.where("val = 1")
        counts = trees.boosted(fit, TREE_FEATURES, "cnt", trees.POISSON, rounds=TREE_ROUNDS, depth=3)
        r = counts.predict(new).agg(metrics.r2("cnt", "pred").alias("r2"), metrics.rmse("cnt", "pred").alias("rmse")).first()
        label = trees.boosted(fit, TREE_FEATURES, "label", trees.LOGISTIC, rounds=TREE_ROUNDS, depth=3)
        auc = metrics.roc_auc(label.predict(new, "p").select("label", "p"), "label", "p").first()["auc"]
    return result(spark, [{"r2": r["r2"], "rmse": r["rmse"], "auc": auc, "n_trees": len(counts.trees), "stop": counts.stop}], "r2 double, rmse double, auc double, n_trees int, stop string")


@query("M13_stacked_residual", f"""WITH {LABELLED}, z AS (SELECT *, ln(1 + cnt) AS z FROM labelled), l AS (SELECT regr_slope(z, temp) AS w, regr_intercept(z, temp) AS b FROM z WHERE val = 0),
e AS (SELECT z.*, b + w * temp AS eta, z - (b + w * temp) AS r FROM z, l), t AS (SELECT avg(r) AS m FROM e WHERE val = 0),
hh AS (SELECT hr, count(*) * m - sum(r) AS g, count(*) AS h, count(*) AS n FROM e, t WHERE val = 0 GROUP BY hr, m), {_HOUR_CUT},
x AS (SELECT e.*, eta + m + CASE WHEN e.hr <= k.hr THEN low ELSE high END AS f FROM e, t, best k), s AS (SELECT sum((cnt + 1) * exp(f)) / sum(exp(2 * f)) AS s, ln(1 + max(cnt)) + 1 AS cap FROM x WHERE val = 0)
SELECT instant, round(greatest(s * exp(least(f, cap)) - 1, 0), 6) AS pred FROM x, s WHERE val = 1""")
def stacked_stump(spark, d):
    """One cut on the residual of a one-column linear score, the two added before the back-transform."""
    df = labelled(spark, d)
    w = solvers.least_squares(*gm.normal_equations(df.where("val = 0"), F.log1p("cnt"), ["temp"])[:2], alpha=0.0)
    scored = df.withColumn("eta", F.col("temp") * float(w[1]) + float(w[0]))
    return rounded(trees.stacked_residual(scored.where("val = 0"), scored.where("val = 1"), ["hr"], "cnt", "eta", 0.0, **_STUMP).select("instant", "pred"))


@query("M13_stacked_residual_plan")
def stacked(spark, d):
    """Trees on the residual of a linear score."""
    with kept(labelled(spark, d)) as df:
        m = Design(SMALL_PLAN, EPOCH).fit(df.where("val = 0"))
        t = PowerTarget(POWER, "ls")
        cols = m.columns()
        named = df.select("val", "cnt", *TREE_FEATURES, *[c.alias(f"_x{i}") for i, c in enumerate(cols.values())])
        g, c, _ = gm.normal_equations(named.where("val = 0"), t.forward("cnt"), [f"_x{i}" for i in range(len(cols))])
        w = solvers.least_squares(g, c)
        scored = named.withColumn("eta", linear_score({f"_x{i}": float(v) for i, v in enumerate(w[1:])}, float(w[0])))
        out = trees.stacked_residual(scored.where("val = 0"), scored.where("val = 1"), TREE_FEATURES, "cnt", "eta", POWER, rounds=TREE_ROUNDS, depth=3)
        r = out.agg(metrics.r2("cnt", "pred").alias("r2"), metrics.rmse("cnt", "pred").alias("rmse")).first()
    return result(spark, [r.asDict()], "r2 double, rmse double")
