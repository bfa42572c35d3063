"""Queries: splits and resampling, metrics, labels, selection and scoring."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from hourwise.functions.target import PowerTarget
from hourwise.operators import bootstrap as bt
from hourwise.operators import labels, metrics, scoring, selection, splits
from hourwise.operators.ranks import hash32
from hourwise.queries.audits import _PRED, agreement, scored
from hourwise.queries.base import CUT_DATE, DEMAND, EPOCH, LABELLED, SEED, demand, hash_sql, labelled, query, r6, rounded, settled
from hourwise.queries.models import _ETA, _FEATURES, feature_weights
from hourwise.session import kept
from hourwise.sources.tables import table

# ----------------------------------------------------------------------------- splits


@query("T1_seeded_exact_split", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(SEED, 'o_orderkey')}, o_orderkey) AS k FROM orders)
SELECT o_orderkey, CASE WHEN k <= ceil((SELECT count(*) FROM orders) * 0.2) THEN 1 ELSE 0 END AS val FROM r""")
def seeded_exact_split(spark, d):
    """Exactly a fifth of the rows held out, by hash order."""
    return splits.seeded_split(table(spark, d, "orders", ["o_orderkey"]), "o_orderkey", SEED, 0.2)


@query("T1_seeded_threshold_split", f"SELECT o_orderkey, CASE WHEN {hash_sql(SEED, 'o_orderkey')} < {int(0.2 * 2 ** 32)} THEN 1 ELSE 0 END AS val FROM orders")
def seeded_threshold_split(spark, d):
    """About a fifth held out, decided row by row."""
    return splits.seeded_split(table(spark, d, "orders", ["o_orderkey"]), "o_orderkey", SEED, 0.2, exact=False)


@query("T3_day_block_folds", """WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), f AS (SELECT d, CAST((dense_rank() OVER (ORDER BY d) - 1) % 5 AS INTEGER) AS fold FROM x)
SELECT o_orderkey, fold FROM orders JOIN f ON f.d = CAST(o_orderdate AS DATE)""")
def day_block_folds(spark, d):
    """Whole dates per fold."""
    o = table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return splits.day_folds(o, "d", 5).select("o_orderkey", "fold")


@query("T4_chronological_split", f"WITH {LABELLED} SELECT late, count(*)::BIGINT AS n, min(dteday) AS first_day, max(dteday) AS last_day FROM labelled GROUP BY late")
def chronological_split(spark, d):
    """Sides of a date, with their ranges."""
    return labelled(spark, d).groupBy("late").agg(F.count("*").alias("n"), F.min("dteday").alias("first_day"), F.max("dteday").alias("last_day"))


@query("T5_nested_day_subsets", f"""WITH x AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT d, n, row_number() OVER (ORDER BY {hash_sql(SEED, 'd')}, d) AS place, count(*) OVER () AS k FROM x), f AS (SELECT * FROM (VALUES (0, 0.1), (1, 0.4), (2, 1.0)) t(subset, share))
SELECT CAST(subset AS INTEGER) AS subset, max(CAST(greatest(round_even(k * share, 0), 1) AS INTEGER)) AS n_days, sum(n)::BIGINT AS n_rows FROM r, f
WHERE place <= greatest(round_even(k * share, 0), 1) GROUP BY subset""")
def nested_day_subsets(spark, d):
    """Growing prefixes of one seeded order of dates."""
    o = table(spark, d, "orders", ["o_orderdate"]).select(F.to_date("o_orderdate").alias("d"))
    return splits.nested_day_subsets(o, "d", [0.1, 0.4, 1.0], SEED).groupBy("subset").agg(F.max("n_days").alias("n_days"), F.count("*").alias("n_rows"))


# ----------------------------------------------------------------------------- resampling

DRAWS = 1000
_M32 = 4294967295


_MIXED = f"""{_PRED}, src AS (SELECT instant, cnt AS y, pred AS pa, pred * 0.9::DOUBLE + 0.3::DOUBLE AS pb FROM scored), draws AS (SELECT unnest(range({DRAWS})) AS b),
s0 AS (SELECT b, ({SEED} + b::BIGINT * {bt.STEP}) & {_M32} AS x FROM draws), s1 AS (SELECT b, xor(x, x >> 16) AS x FROM s0),
s2 AS (SELECT b, CAST((x::HUGEINT * {bt.MIX_A}) % 4294967296 AS BIGINT) AS x FROM s1), s3 AS (SELECT b, xor(x, x >> 15) AS x FROM s2),
s4 AS (SELECT b, CAST((x::HUGEINT * {bt.MIX_B}) % 4294967296 AS BIGINT) AS x FROM s3), st AS (SELECT b, xor(x, x >> 16) AS s FROM s4),
h0 AS (SELECT b, y, pa, pb, instant, xor(instant & {_M32}, s) AS x FROM src, st), h1 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM h0),
h2 AS (SELECT * REPLACE (CAST((x::HUGEINT * {bt.MIX_A}) % 4294967296 AS BIGINT) AS x) FROM h1), h3 AS (SELECT * REPLACE (xor(x, x >> 15) AS x) FROM h2),
h4 AS (SELECT * REPLACE (CAST((x::HUGEINT * {bt.MIX_B}) % 4294967296 AS BIGINT) AS x) FROM h3),
r0 AS (SELECT b, y, pa, pb, xor(xor(x, x >> 16), instant >> 32) AS x FROM h4), r1 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM r0),
r2 AS (SELECT * REPLACE (CAST((x::HUGEINT * {bt.MIX_A}) % 4294967296 AS BIGINT) AS x) FROM r1), r3 AS (SELECT * REPLACE (xor(x, x >> 15) AS x) FROM r2),
r4 AS (SELECT * REPLACE (CAST((x::HUGEINT * {bt.MIX_B}) % 4294967296 AS BIGINT) AS x) FROM r3), r5 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM r4),
w AS (SELECT b, y, pa, pb, {' + '.join(f'(CASE WHEN x >= {c} THEN 1 ELSE 0 END)' for c in bt.POISSON_CUTS)} AS w FROM r5),
g AS (SELECT b, sum(w * (y - pa) ** 2) AS ea, sum(w * (y - pb) ** 2) AS eb, sum(w * y * y) - sum(w * y) ** 2 / sum(w)::DOUBLE AS sst FROM w GROUP BY b)"""
_QUANT = "round(quantile_cont({v}, 0.025), 6) AS lo, round(quantile_cont({v}, 0.975), 6) AS hi, round(stddev_samp({v}), 6) AS se"


def _two_predictions(spark, d):
    return scored(spark, d).select("instant", "dteday", "cnt", F.col("pred").alias("pa"), (F.col("pred") * 0.9 + 0.3).alias("pb"))


@query("T6_row_bootstrap", f"WITH {_MIXED} SELECT {_QUANT.format(v='1 - ea / sst')} FROM g")
def row_bootstrap(spark, d):
    """Interval of R2 from Poisson row weights in one pass."""
    sums = bt.row_bootstrap_sums(_two_predictions(spark, d), "instant", "cnt", ["pa"], DRAWS, SEED)
    return rounded(bt.interval(bt.r2_of(sums, "pa")))


@query("T7_paired_bootstrap", f"WITH {_MIXED} SELECT {_QUANT.format(v='(eb - ea) / sst')} FROM g")
def paired_bootstrap(spark, d):
    """Interval of the difference of two R2 on the same draws."""
    sums = bt.row_bootstrap_sums(_two_predictions(spark, d), "instant", "cnt", ["pa", "pb"], DRAWS, SEED)
    return rounded(bt.interval(bt.r2_of(sums, "pa", "pb")))


_DAYS = f"""{_PRED}, pd AS (SELECT dteday, count(*)::DOUBLE AS n, sum(cnt)::DOUBLE AS sy, sum(cnt * cnt)::DOUBLE AS syy, sum((cnt - pred) ** 2) AS sse FROM scored GROUP BY dteday),
nd AS (SELECT *, row_number() OVER (ORDER BY dteday) - 1 AS g, count(*) OVER () AS k FROM pd)"""
_DRAWN = f"""dr AS (SELECT b, slot, {hash_sql(SEED, 'b', 'slot')} % (SELECT max(k) FROM nd) AS g FROM (SELECT unnest(range({DRAWS})) AS b), (SELECT unnest(range((SELECT max(k) FROM nd))) AS slot))"""


@query("T8_group_bootstrap", f"""WITH {_DAYS}, {_DRAWN}, v AS (SELECT b, 1 - sum(sse) / (sum(syy) - sum(sy) ** 2 / sum(n)) AS v FROM dr JOIN nd USING (g) GROUP BY b) SELECT {_QUANT.format(v='v')} FROM v""")
def group_bootstrap(spark, d):
    """Interval of R2 when whole days are drawn, exact from per-day sums."""
    with kept(scored(spark, d).select("dteday", "cnt", "pred")) as rows:
        return settled(rounded(bt.interval(bt.r2_of(bt.group_bootstrap_sums(rows, "dteday", "cnt", ["pred"], DRAWS, SEED), "pred"))))


@query("T9_days_without_replacement", f"""WITH {_DAYS}, p AS (SELECT b, n, sy, syy, sse, row_number() OVER (PARTITION BY b ORDER BY {hash_sql(SEED, 'b', 'dteday')}, dteday) AS place
FROM pd, (SELECT unnest(range({DRAWS})) AS b)), v AS (SELECT b, 1 - sum(sse) / (sum(syy) - sum(sy) ** 2 / sum(n)) AS v FROM p WHERE place <= 12 GROUP BY b) SELECT {_QUANT.format(v='v')} FROM v""")
def days_without_replacement(spark, d):
    """Spread of R2 over samples of twelve days."""
    sums = bt.subset_sums(scored(spark, d), "dteday", "cnt", "pred", DRAWS, 12, SEED)
    return rounded(bt.interval(bt.r2_of(sums, "pred")))


@query("T10_group_multiplicities", f"""WITH {_DAYS}, {_DRAWN} SELECT CAST(b AS INTEGER) AS b, dteday, CAST(count(*) AS INTEGER) AS times FROM dr JOIN nd USING (g) GROUP BY ALL""")
def group_multiplicities(spark, d):
    """How often each day is drawn in each resample."""
    days = splits.numbered_groups(scored(spark, d), "dteday")
    drawn = splits.group_draws(days.count(), DRAWS, SEED, spark)
    return drawn.join(days, "group_no").select("b", "dteday", "times")


# ----------------------------------------------------------------------------- regression metrics

@query("E1_r2_rmse", f"WITH {_PRED} SELECT late, round(1 - sum(e * e) / (var_pop(cnt) * count(*)), 6) AS r2, round(sqrt(avg(e * e)), 6) AS rmse FROM (SELECT *, dteday >= DATE '{CUT_DATE}' AS late FROM scored) GROUP BY late")
def r2_rmse(spark, d):
    """R2 around the mean of the evaluated rows, and RMSE."""
    late = F.col("dteday") >= F.lit(CUT_DATE).cast("date")
    return rounded(scored(spark, d).groupBy(late.alias("late")).agg(metrics.r2("cnt", "pred").alias("r2"), metrics.rmse("cnt", "pred").alias("rmse")))


_E9 = """SELECT '{m}' AS method, round({s}, 6) AS factor, round(1 - sum((cnt - greatest({s} * exp(eta) - 1, 0)) ** 2) / (var_pop(cnt) * count(*)), 6) AS r2,
round(sqrt(avg((cnt - greatest({s} * exp(eta) - 1, 0)) ** 2)), 6) AS rmse, round(avg(greatest({s} * exp(eta) - 1, 0)) / avg(cnt), 6) AS mean_ratio,
count(*) FILTER ({s} * exp(eta) - 1 < 0)::BIGINT AS n_clipped FROM e, f GROUP BY ls, duan, best"""


@query("E9_back_transform_table", f"""WITH {_ETA}, f AS (SELECT sum((cnt + 1) * exp(eta)) / sum(exp(eta) * exp(eta)) AS ls, avg(exp(ln(1 + cnt) - eta)) AS duan, (SELECT sum((cnt + 1) * exp(eta)) / sum(exp(eta) * exp(eta)) FROM e) AS best FROM e WHERE dteday < DATE '{CUT_DATE}')
{_E9.format(m='none', s='1.0::DOUBLE')} UNION ALL {_E9.format(m='ls', s='ls')} UNION ALL {_E9.format(m='duan', s='duan')} UNION ALL {_E9.format(m='best', s='best')}""")
def back_transform_table(spark, d):
    """Scores of every back-transform factor learned before the cut, and of the best one for the evaluated rows themselves."""
    df = demand(spark, d).withColumn("eta", F.log(F.col("temp") * 4 + 2))
    fit = df.where(F.col("dteday") < F.lit(CUT_DATE).cast("date"))
    s = fit.agg(*[PowerTarget(0.0, b).factor_column("eta", "cnt").alias(b) for b in ("none", "ls", "duan")]).first().asDict()
    s["best"] = PowerTarget(0.0, "ls").factor(df, "eta", "cnt")
    return rounded(metrics.back_transform_table(df, 0.0, s, "cnt", "eta"))


_FS = f"""{DEMAND}, fs AS (SELECT CAST(dayofmonth(dteday) % 5 AS INTEGER) AS fold, CAST(hr AS DOUBLE) AS alpha, avg(temp) AS score, avg(atemp) * 0.5 AS other FROM demand GROUP BY ALL)"""


def fold_scores(spark, d):
    return demand(spark, d).groupBy((F.dayofmonth("dteday") % 5).alias("fold"), F.col("hr").cast("double").alias("alpha")).agg(
        F.avg("temp").alias("score"), (F.avg("atemp") * 0.5).alias("other"))


@query("E12_one_standard_error_rule", f"""WITH {_FS}, p AS (SELECT alpha, avg(score) AS mean, stddev_samp(score) / sqrt(count(*)) AS se FROM fs GROUP BY alpha),
b AS (SELECT alpha AS ba, mean AS bm, se AS bs FROM p ORDER BY mean DESC, alpha DESC LIMIT 1)
SELECT alpha, round(mean, 6) AS mean, round(se, 6) AS se, alpha = ba AS is_best, alpha = max(CASE WHEN mean >= bm - bs THEN alpha END) OVER () AS is_1se FROM p, b""")
def one_standard_error(spark, d):
    """Best setting by fold mean, and the largest within one standard error of it."""
    return rounded(selection.cv_summary(fold_scores(spark, d).select("alpha", "score")))


@query("E14_fit_rule", f"""WITH {_FS}, g AS (SELECT fold, regr_slope(score, alpha) AS gain, min(score - other) AS lo, max(score - other) AS hi, count(*) AS n FROM fs GROUP BY fold)
SELECT fold, CASE WHEN n % 7 > 2 AND lo > 0 AND gain > 0 THEN 'under-fit' WHEN n % 7 < 2 AND hi < 0 AND gain < 0 THEN 'over-fit' ELSE 'reasonably fit' END AS verdict FROM g""")
def fit_rule(spark, d):
    """Under-fit, over-fit or reasonable, from level numbers, an interval and a fold gain."""
    gap = F.col("score") - F.col("other")
    g = fold_scores(spark, d).groupBy("fold").agg(F.regr_slope("score", "alpha").alias("gain"), F.min(gap).alias("lo"), F.max(gap).alias("hi"), F.count("*").alias("n"))
    return g.select("fold", selection.fit_rule(F.lit(2), F.col("n") % 7, F.col("lo"), F.col("hi"), F.col("gain")).alias("verdict"))


@query("E15_operator_cost", f"""WITH {_PRED} SELECT round(avg(CASE WHEN e < 0 THEN 3 ELSE 1 END * e * e), 6) AS sq_cost, round(avg(CASE WHEN e < 0 THEN 3 ELSE 1 END * abs(e)), 6) AS abs_cost,
round(avg(CASE WHEN e < 0 THEN 1.0 ELSE 0 END), 6) AS under_share, round(avg(e), 6) + 0.0 AS mean_error FROM scored""")
def operator_cost(spark, d):
    """Costs when an under-prediction is three times as dear."""
    return rounded(scored(spark, d).agg(*[c.alias(n) for n, c in metrics.operator_costs("cnt", "pred", 3.0).items()]))


@query("E28_fold_delta", f"""WITH {_FS} SELECT alpha, round(avg(score - other), 6) + 0.0 AS delta, round(stddev_samp(score - other) / sqrt(count(*)), 6) AS se, count(*) FILTER (score > other)::BIGINT AS wins,
count(*)::BIGINT AS n_folds FROM fs GROUP BY alpha""")
def fold_delta(spark, d):
    """Paired differences across folds."""
    return rounded(selection.fold_delta(fold_scores(spark, d), ["alpha"], "score", "other"))


@query("E29_heteroscedasticity", f"""WITH {_PRED}, q AS (SELECT list_sort(list_distinct(quantile_cont(pred, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS q FROM scored),
x AS (SELECT e, pred, len(list_filter(q[2:-2], lambda v: pred > v)) AS dec FROM scored, q)
SELECT round(corr(abs(e), pred), 6) + 0.0 AS corr, round(stddev_samp(e) FILTER (dec = 0), 6) AS sd_low, round(stddev_samp(e) FILTER (dec = (SELECT max(dec) FROM x)), 6) AS sd_high FROM x""")
def heteroscedasticity(spark, d):
    """Does the error grow with the prediction?"""
    df = scored(spark, d).select("e", r6("pred", 9).alias("pred"))
    with kept(df) as rows:
        return settled(rounded(metrics.heteroscedasticity(rows, "e", "pred")))


# ----------------------------------------------------------------------------- classification metrics on document labels

_DOC = "dl AS (SELECT n_chars / (n_chars + 600.0::DOUBLE) AS p, ln(n_chars / 600.0::DOUBLE) AS eta, quality AS y FROM documents JOIN labels USING (doc_id))"


def document_scores(spark, d):
    """Quality label and a score that grows with the length of the text."""
    rows = table(spark, d, "documents", ["doc_id", "n_chars"]).join(table(spark, d, "labels", ["doc_id", "quality"]), "doc_id")
    n = F.col("n_chars")
    return rows.select("doc_id", (n / (n + 600.0)).alias("p"), F.log(n / 600.0).alias("eta"), F.col("quality").alias("y"))


@query("E17_log_loss", f"WITH {_DOC} SELECT round(avg(-y * ln(1 / (1 + exp(-eta))) - (1 - y) * ln(1 - 1 / (1 + exp(-eta)))), 6) AS log_loss FROM dl")
def log_loss(spark, d):
    """Mean cross-entropy of a linear score."""
    return rounded(document_scores(spark, d).agg(metrics.log_loss("y", "eta").alias("log_loss")))


@query("E18_roc_auc", f"""WITH {_DOC}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM dl)
SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1))::DOUBLE, 6) AS auc,
count(*) FILTER (y = 1)::BIGINT AS n_pos, count(*) FILTER (y <> 1)::BIGINT AS n_neg FROM r""")
def roc_auc(spark, d):
    """Area under the ROC curve, ties counted half."""
    return rounded(metrics.roc_auc(document_scores(spark, d), "y", "p"))


@query("E19_average_precision", f"""WITH {_DOC}, h AS (SELECT p, count(*) FILTER (y = 1) AS a, count(*) AS n FROM dl GROUP BY p),
c AS (SELECT a, sum(a) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM h) SELECT round(sum(a * tp / k::DOUBLE) / sum(a), 6) AS pr_auc FROM c""")
def average_precision(spark, d):
    """Recall steps times precision over distinct scores."""
    return rounded(metrics.average_precision(document_scores(spark, d), "y", "p"))


_CONF = "count(*) FILTER (p >= {t} AND y = 1) AS tp, count(*) FILTER (p >= {t} AND y <> 1) AS fp, count(*) FILTER (p < {t} AND y <> 1) AS tn, count(*) FILTER (p < {t} AND y = 1) AS fn"
_RATES = """tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy,
round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1"""


@query("E20_confusion", f"WITH {_DOC}, c AS (SELECT {_CONF.format(t='0.5')} FROM dl) SELECT {_RATES} FROM c")
def confusion(spark, d):
    """Counts and rates at one threshold."""
    return rounded(metrics.with_rates(document_scores(spark, d).agg(*[c.alias(n) for n, c in metrics.confusion("y", "p", 0.5).items()])))


THRESHOLDS = [round(0.05 * k, 2) for k in range(1, 20)]
_SWEEP = f"""{_DOC}, t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS thr), c AS (SELECT thr, {_CONF.format(t='thr')} FROM dl, t GROUP BY thr),
s AS (SELECT thr, {_RATES}, round((3 * fn + fp) / (tp + fp + tn + fn)::DOUBLE, 6) AS cost FROM c)"""


@query("E21_threshold_sweep", f"WITH {_SWEEP} SELECT * FROM s")
def threshold_sweep(spark, d):
    """Nineteen thresholds from one count of the rows between them."""
    return rounded(metrics.threshold_sweep(document_scores(spark, d), "y", "p", THRESHOLDS, 3.0))


@query("E21_best_thresholds", f"WITH {_SWEEP} SELECT (SELECT thr FROM s ORDER BY f1 DESC, thr LIMIT 1) AS best_f1, (SELECT thr FROM s ORDER BY cost, thr LIMIT 1) AS best_cost, 0.25::DOUBLE AS rule")
def best_thresholds(spark, d):
    """Best threshold by F1 and by cost, beside the rule 1 / (1 + cost ratio)."""
    sweep = rounded(metrics.threshold_sweep(document_scores(spark, d), "y", "p", THRESHOLDS, 3.0))
    return metrics.best_thresholds(sweep).withColumn("rule", F.lit(1.0 / (1.0 + 3.0)))


@query("E22_curve_points", f"""WITH {_DOC}, h AS (SELECT p, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b, count(*) AS n FROM dl GROUP BY p),
c AS (SELECT p, n, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(n) OVER w AS k, sum(a) OVER () AS ta, sum(b) OVER () AS tb, sum(n) OVER () AS tn FROM h WINDOW w AS (ORDER BY p DESC)),
i AS (SELECT DISTINCT i * (tn - 1) // 39 AS spot FROM (SELECT unnest(range(40)) AS i), (SELECT max(tn) AS tn FROM c))
SELECT p AS thr, round(fp / tb::DOUBLE, 6) AS fpr, round(tp / ta::DOUBLE, 6) AS recall, round(tp / (tp + fp)::DOUBLE, 6) AS precision FROM c WHERE EXISTS (SELECT 1 FROM i WHERE spot BETWEEN k - n AND k - 1)""")
def curve_points(spark, d):
    """ROC and PR points at about forty positions of the ranking."""
    out = metrics.curve_points(document_scores(spark, d), "y", "p", 40)
    return out.select("thr", *[r6(c).alias(c) for c in ("fpr", "recall", "precision")])


_EDGES = [float(e) for e in np.linspace(0.0, 1.0, 11)]


@query("E23_calibration", f"""WITH {_DOC}, b AS (SELECT y, p, CAST({' + '.join(f'CASE WHEN p >= {e!r}::DOUBLE THEN 1 ELSE 0 END' for e in _EDGES[1:10])} AS INTEGER) AS bin FROM dl),
g AS (SELECT bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS frac_pos FROM b GROUP BY bin), e AS (SELECT CAST(i AS INTEGER) AS bin FROM (SELECT unnest(range(10)) AS i))
SELECT e.bin, coalesce(n, 0)::BIGINT AS n, round(mean_p, 6) AS mean_p, round(frac_pos, 6) AS frac_pos FROM e LEFT JOIN g USING (bin)""")
def calibration(spark, d):
    """Equal-width bins with the mean score and the share positive."""
    return rounded(metrics.calibration(document_scores(spark, d), "y", "p").drop("lo", "hi"))


@query("E23_largest_calibration_gap", f"""WITH {_DOC}, b AS (SELECT y, p, CAST({' + '.join(f'CASE WHEN p >= {e!r}::DOUBLE THEN 1 ELSE 0 END' for e in _EDGES[1:10])} AS INTEGER) AS bin FROM dl),
g AS (SELECT abs(avg(p) - avg(y)) AS gap FROM b GROUP BY bin HAVING count(*) >= 30) SELECT round(max(gap), 6) AS max_gap FROM g""")
def calibration_gap(spark, d):
    """Largest gap between mean score and share positive over bins with at least 30 rows."""
    return rounded(metrics.largest_calibration_gap(metrics.calibration(document_scores(spark, d), "y", "p"), 30))


def _mixed_sql(name: str, x: str, columns: str, source: str) -> str:
    """One round of the 32-bit mixer over x, as common table expressions; the last one is `name`."""
    return (f"{name}0 AS (SELECT {columns}, {x} AS x FROM {source}), {name}1 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM {name}0), "
            f"{name}2 AS (SELECT * REPLACE (CAST((x::HUGEINT * {bt.MIX_A}) % 4294967296 AS BIGINT) AS x) FROM {name}1), {name}3 AS (SELECT * REPLACE (xor(x, x >> 15) AS x) FROM {name}2), "
            f"{name}4 AS (SELECT * REPLACE (CAST((x::HUGEINT * {bt.MIX_B}) % 4294967296 AS BIGINT) AS x) FROM {name}3), {name} AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM {name}4)")


_AUC_DRAWS = f"""{_DOC}, sc AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y <> 1) AS neg, row_number() OVER (ORDER BY p) AS number FROM dl GROUP BY p),
src AS (SELECT number, 1 AS cls, pos AS n, 2 * number + 1 AS key FROM sc WHERE pos > 0 UNION ALL SELECT number, 0, neg, 2 * number FROM sc WHERE neg > 0),
{_mixed_sql('s', f"({SEED} + b::BIGINT * {bt.STEP}) & {_M32}", 'b', f'(SELECT unnest(range({DRAWS})) AS b)')},
{_mixed_sql('h', f'xor(key & {_M32}, s.x)', 's.b, number, cls, n, key', 'src, s')}, {_mixed_sql('r', 'xor(h.x, key >> 32)', 'b, number, cls, n', 'h')},
cd AS (SELECT n, k, sum(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS c FROM (SELECT DISTINCT n FROM src), (SELECT unnest(range(80)) AS k)),
cl AS (SELECT n, list(c ORDER BY k) AS cs FROM cd GROUP BY n), w AS (SELECT b, number, cls, len(list_filter(cs, lambda c: (x + 0.5) / 4294967296.0::DOUBLE >= c)) AS w FROM r JOIN cl USING (n)),
j AS (SELECT b, number, coalesce(sum(w) FILTER (cls = 1), 0) AS up, coalesce(sum(w) FILTER (cls = 0), 0) AS down FROM w GROUP BY b, number),
k AS (SELECT *, sum(down) OVER (PARTITION BY b ORDER BY number) - down / 2.0::DOUBLE AS below FROM j), g AS (SELECT b, sum(up * below) / (sum(up) * sum(down)) AS v FROM k GROUP BY b)"""


@query("E24_auc_interval", f"WITH {_AUC_DRAWS} SELECT {_QUANT.format(v='v')} FROM g")
def auc_interval(spark, d):
    """Bootstrap interval of the ROC-AUC."""
    return rounded(bt.interval(bt.auc_bootstrap(document_scores(spark, d), "y", "p", DRAWS, SEED)))


# ----------------------------------------------------------------------------- labels

_CELLS = f"{DEMAND}, c AS (SELECT entity, workingday, hr, quantile_cont(cnt, 0.75) AS threshold, count(*) AS n FROM demand WHERE dteday < DATE '{CUT_DATE}' GROUP BY ALL)"


def _cells(spark, d):
    df = demand(spark, d)
    return df, labels.fit_thresholds(df.where(F.col("dteday") < F.lit(CUT_DATE).cast("date")), ["entity", "workingday", "hr"], "cnt", 0.75)


@query("L1_fit_thresholds", f"WITH {_CELLS} SELECT entity, workingday, hr, round(threshold, 6) AS threshold, n::BIGINT AS n FROM c")
def fit_thresholds(spark, d):
    """Quantile and size of every cell, from the rows before the cut."""
    return rounded(_cells(spark, d)[1])


@query("L2_apply_thresholds", f"WITH {DEMAND}, k AS (SELECT workingday, hr, quantile_cont(cnt, 0.75) AS t FROM demand WHERE dteday < DATE '{CUT_DATE}' GROUP BY ALL) SELECT instant, CAST(cnt > t AS INTEGER) AS label FROM demand LEFT JOIN k USING (workingday, hr) WHERE dteday >= DATE '{CUT_DATE}'")
def apply_thresholds(spark, d):
    """Label of every later row, strictly above the threshold of its hour and day type; a cell never seen is an error."""
    df, keys = demand(spark, d), ["workingday", "hr"]
    cells = labels.fit_thresholds(df.where(F.col("dteday") < F.lit(CUT_DATE).cast("date")), keys, "cnt", 0.75)
    return labels.apply_thresholds(df.where(F.col("dteday") >= F.lit(CUT_DATE).cast("date")), cells, keys, "cnt").select("instant", "label")


@query("L3_describe_rule", f"WITH {_CELLS} SELECT count(*)::BIGINT AS n_cells, min(n)::BIGINT AS min_cell_n FROM c")
def describe_rule(spark, d):
    """Number of cells and the smallest."""
    return labels.describe_rule(_cells(spark, d)[1])


# ----------------------------------------------------------------------------- selection

_NUM = ("temp", "atemp", "hum", "windspeed", "hr")


@query("V1_largest_correlation", f"WITH {DEMAND}, c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS \"column\", '{b}' AS other, abs(corr({a}, {b})) AS v FROM demand" for a in _NUM for b in _NUM if a != b)
    + ") SELECT \"column\", round(max(v), 6) AS value, arg_max(other, v) AS other FROM c GROUP BY 1")
def largest_correlation(spark, d):
    """Closest other column of each column, from one Gram pass."""
    from hourwise.operators.gram import gram_table
    df = demand(spark, d)
    g = gram_table(df.select(*_NUM), {"_one": F.lit(1.0), **{c: F.col(c) for c in _NUM}})
    m = g.where("a = '_one'").select(F.col("b").alias("c"), F.col("value").alias("mean")).where("c <> '_one'")
    cov = (g.where("a <> '_one'").join(m.withColumnsRenamed({"c": "a", "mean": "ma"}), "a").join(m.withColumnsRenamed({"c": "b", "mean": "mb"}), "b")
           .select("a", "b", (F.col("value") - F.col("ma") * F.col("mb")).alias("cov")))
    var = cov.where("a = b").select(F.col("a").alias("c"), F.sqrt("cov").alias("sd"))
    pairs = (cov.where("a <> b").join(var.withColumnsRenamed({"c": "a", "sd": "sa"}), "a").join(var.withColumnsRenamed({"c": "b", "sd": "sb"}), "b")
             .select("a", "b", F.abs(F.when((F.col("sa") > 1e-9) & (F.col("sb") > 1e-9), F.col("cov") / (F.col("sa") * F.col("sb"))).otherwise(0.0)).alias("v")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "v"))
    return rounded(both.groupBy(F.col("a").alias("column")).agg(F.max("v").alias("value"), F.max_by("b", "v").alias("other")))


def _vif(t, x, y):
    return f"round(1 / (1 - (r_{t}{x} ** 2 + r_{t}{y} ** 2 - 2 * r_{t}{x} * r_{t}{y} * r_{x}{y}) / (1 - r_{x}{y} ** 2)), 6)"


@query("V2_variance_inflation", f"""WITH {DEMAND}, r AS (SELECT corr(temp, hum) AS r_th, corr(temp, hum) AS r_ht, corr(temp, windspeed) AS r_tw, corr(temp, windspeed) AS r_wt, corr(hum, windspeed) AS r_hw, corr(hum, windspeed) AS r_wh FROM demand)
SELECT 'temp' AS name, {_vif('t', 'h', 'w')} AS vif FROM r UNION ALL SELECT 'hum', {_vif('h', 't', 'w')} FROM r UNION ALL SELECT 'windspeed', {_vif('w', 't', 'h')} FROM r""")
def variance_inflation(spark, d):
    """Variance inflation of each column given the others."""
    from hourwise.operators.gram import normal_equations
    from hourwise.plans import solvers
    from hourwise.queries.models import result
    names = ["temp", "hum", "windspeed"]
    g, c, _ = normal_equations(demand(spark, d), F.lit(0.0), names)
    corr = solvers.correlation(solvers.centred(g, c)[0])
    return result(spark, [{"name": n, "vif": solvers.inflation(corr, i)} for i, n in enumerate(names)], "name string, vif double")


@query("V5_entry_alphas", """WITH p AS (SELECT p_brand AS feature, CAST(p_size AS DOUBLE) AS alpha, avg(p_retailprice) AS v FROM part GROUP BY ALL)
SELECT feature, max(CASE WHEN v > 1000 THEN alpha END) AS entry_alpha FROM p GROUP BY feature""")
def entry_alphas(spark, d):
    """Largest setting at which each feature has a non-zero weight."""
    path = table(spark, d, "part", ["p_brand", "p_size", "p_retailprice"]).groupBy(F.col("p_brand").alias("feature"), F.col("p_size").cast("double").alias("alpha")).agg(
        F.avg("p_retailprice").alias("v")).withColumn("weight", F.when(F.col("v") > 1000, F.col("v")).otherwise(0.0))
    return selection.entry_alphas(path)


# evidence stand-in: simple explained shares of each column, with a fixed margin as the interval
_EV_COLS = ("temp", "atemp", "hum", "windspeed", "weekday", "workingday", "holiday", "hr", "weathersit")
_EV = f"{DEMAND}, evi AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(regr_r2(cnt, {c}) - 0.01, 9) AS delta, round(regr_r2(cnt, {c}) - 0.02, 9) AS lo, round(regr_r2(cnt, {c}), 9) AS hi, "
    f"{'NULL::DOUBLE' if c in ('hum', 'windspeed', 'hr', 'weathersit') else f'round(regr_r2(cnt, {c}) * 2, 9)'} AS group_delta, "
    f"{'NULL::DOUBLE' if c in ('hum', 'windspeed', 'hr', 'weathersit') else f'round(regr_r2(cnt, {c}) * 2 - 0.001, 9)'} AS group_lo, "
    f"round(regr_r2(cnt, {c}), 9) AS solo_r2, round(abs(corr({c}, {'temp' if c != 'temp' else 'atemp'})), 9) AS max_abs_corr, '{'temp' if c != 'temp' else 'atemp'}' AS corr_with FROM demand"
    for c in _EV_COLS) + ")"
_VERDICT = f"""{_EV}, b AS (SELECT *, coalesce(group_lo > 0 AND group_delta >= 0.001, FALSE) AS gh, CASE WHEN lo > 0 AND delta >= 0.001 THEN 'useful'
 WHEN coalesce(group_lo > 0 AND group_delta >= 0.001, FALSE) OR solo_r2 >= 0.01 THEN 'redundant' ELSE 'uninformative' END AS v FROM evi),
gr AS (SELECT * FROM (VALUES ('temperature', 'temp'), ('temperature', 'atemp'), ('daytype', 'weekday'), ('daytype', 'workingday'), ('daytype', 'holiday')) t(g, "column")),
pr AS (SELECT g, arg_max("column", solo_r2) AS keeper FROM b JOIN gr USING ("column") GROUP BY g HAVING bool_or(gh) AND NOT bool_or(v = 'useful')),
vd AS (SELECT b.*, CASE WHEN keeper IS NOT NULL THEN 'useful' ELSE v END AS verdict, keeper IS NOT NULL AS representative FROM b LEFT JOIN pr ON keeper = "column")"""


def _varies(a: Column, b: Column) -> Column:
    """Whether `a` has several values among the rows that hold both; a spread of sums is seldom exactly zero."""
    held = F.when(b.isNotNull(), a)
    return F.min(held) < F.max(held)


def _explained(y: Column, x: Column) -> Column:
    """Share of `y` that a line in `x` explains; as in SQL null where `x` does not vary, else one where `y` does not."""
    return F.when(_varies(x, y), F.when(_varies(y, x), F.regr_r2(y, x)).otherwise(1.0))


def _closeness(a: Column, b: Column) -> Column:
    """|r|; as in SQL NaN where one of both does not vary, on which `corr` fails by its division."""
    r = F.try_divide(F.abs(F.regr_sxy(a, b)), F.sqrt(F.regr_sxx(a, b) * F.regr_syy(a, b)))
    return F.when(F.regr_count(a, b) > 0, F.when(_varies(a, b) & _varies(b, a), r).otherwise(float("nan")))


def evidence(spark, d):
    df = demand(spark, d)
    aggs = []
    for c in _EV_COLS:
        x, other = F.col(c).cast("double"), "temp" if c != "temp" else "atemp"
        r = _explained(F.col("cnt").cast("double"), x)
        lone = c in ("hum", "windspeed", "hr", "weathersit")
        none = F.lit(None).cast("double")
        aggs.append(F.struct(F.lit(c).alias("column"), r6(r - 0.01, 9).alias("delta"), r6(r - 0.02, 9).alias("lo"), r6(r, 9).alias("hi"),
                             (none if lone else r6(r * 2, 9)).alias("group_delta"), (none if lone else r6(r * 2 - 0.001, 9)).alias("group_lo"),
                             r6(r, 9).alias("solo_r2"), r6(_closeness(x, F.col(other)), 9).alias("max_abs_corr"), F.lit(other).alias("corr_with")))
    return df.agg(F.array(*aggs).alias("r")).select(F.inline("r"))


@query("V7_column_verdicts", f"""WITH {_VERDICT} SELECT "column", verdict, representative, CASE WHEN verdict <> 'redundant' THEN '' ELSE coalesce((SELECT string_agg(o."column", ', ' ORDER BY list_position(
['season', 'yr', 'mnth', 'hr', 'holiday', 'weekday', 'workingday', 'weathersit', 'temp', 'atemp'], o."column")) FROM vd o JOIN gr a ON a."column" = o."column" JOIN gr c ON c.g = a.g AND c."column" = vd."column"
WHERE o.verdict = 'useful' AND o."column" <> vd."column"), corr_with) END AS carried_by FROM vd""")
def column_verdicts(spark, d):
    """Useful, redundant or uninformative, with representatives and carriers."""
    return selection.verdicts(evidence(spark, d)).select("column", "verdict", "representative", "carried_by")


@query("V9_coefficient_share", f"""WITH {_FEATURES}, x AS (SELECT feature, source, count(*) OVER (PARTITION BY feature) AS k FROM lin), s AS (SELECT source, sum(abs(weight) / k) AS w FROM x JOIN w USING (feature) GROUP BY source)
SELECT source, round(w / sum(w) OVER (), 6) AS share FROM s""")
def coefficient_share(spark, d):
    """Share of the absolute weights per original column."""
    return rounded(selection.coefficient_share(feature_weights(spark, d)))


@query("V10_evidence_text", f"""WITH {_VERDICT} SELECT "column", format('without it R2 changes by {{:.4f}} ({{:.4f}} to {{:.4f}})', -delta, -hi, -lo) ||
CASE WHEN group_delta IS NULL THEN '' ELSE format('; without its whole group by {{:.4f}}', -group_delta) END || format('; by itself it explains {{:.4f}}', solo_r2)
|| format('; closest column {{}} at |r| {{:.3f}}', corr_with, max_abs_corr) || '.' AS evidence FROM vd WHERE verdict <> 'redundant'""")
def evidence_text(spark, d):
    """One sentence per column that is not redundant."""
    table_ = selection.evidence_text(selection.verdicts(evidence(spark, d)))
    return table_.where("verdict <> 'redundant'").select("column", "evidence")


@query("V11_feature_counts", f"""WITH {_FEATURES}, x AS (SELECT feature, source, count(*) OVER (PARTITION BY feature) AS k FROM lin)
SELECT source, count(*) FILTER (k = 1)::BIGINT AS n_own, count(*) FILTER (k = 1 AND weight <> 0)::BIGINT AS n_own_nonzero, count(*)::BIGINT AS n_involving, count(*) FILTER (weight <> 0)::BIGINT AS n_involving_nonzero,
round(max(freq) FILTER (k = 1), 6) AS max_freq_own, round(avg(freq), 6) AS mean_freq_involving FROM x JOIN w USING (feature) GROUP BY source""")
def feature_counts(spark, d):
    """Own and involving features per original column."""
    return rounded(selection.feature_counts(feature_weights(spark, d)))


def _stats_and_verdict(spark, d):
    stats = feature_weights(spark, d)
    verdict = selection.lineage(stats.select("feature")).join(stats, "feature").groupBy(F.col("source").alias("column")).agg(F.avg("freq").alias("f")).select(
        "column", F.when(F.col("f") >= 0.5, "useful").otherwise("uninformative").alias("verdict"))
    return stats, verdict


@query("V8_survivors", f"""WITH {_FEATURES}, u AS (SELECT source FROM lin JOIN w USING (feature) GROUP BY source HAVING avg(freq) >= 0.5),
bad AS (SELECT DISTINCT feature FROM lin WHERE source NOT IN (SELECT source FROM u)) SELECT feature, weight, freq FROM w WHERE feature NOT IN (SELECT feature FROM bad) AND weight <> 0 AND freq >= 0.6""")
def survivors(spark, d):
    """Features of useful columns that are non-zero and stable."""
    return selection.survivors(*_stats_and_verdict(spark, d))


@query("V8_surviving_columns", f"""WITH {_FEATURES}, u AS (SELECT source FROM lin JOIN w USING (feature) GROUP BY source HAVING avg(freq) >= 0.5),
bad AS (SELECT DISTINCT feature FROM lin WHERE source NOT IN (SELECT source FROM u)), k AS (SELECT feature FROM w WHERE feature NOT IN (SELECT feature FROM bad) AND weight <> 0 AND freq >= 0.6)
SELECT DISTINCT source AS "column" FROM lin JOIN k USING (feature)""")
def surviving_columns(spark, d):
    """Original columns that some surviving feature uses."""
    stats, verdict = _stats_and_verdict(spark, d)
    return selection.surviving_columns(selection.survivors(stats, verdict), verdict)


# ----------------------------------------------------------------------------- scoring

@query("R1_batch_scoring", f"""WITH {DEMAND}, e AS (SELECT * FROM demand WHERE dteday < DATE '{CUT_DATE}'), s AS (SELECT avg(temp) AS m, stddev_pop(temp) AS sd FROM e),
l AS (SELECT regr_slope(ln(1 + cnt), (temp - m) / sd) AS w, regr_intercept(ln(1 + cnt), (temp - m) / sd) AS b, ln(1 + max(cnt)) + 1 AS cap FROM e, s),
f AS (SELECT sum((cnt + 1) * exp(b + w * (temp - m) / sd)) / sum(exp(2 * (b + w * (temp - m) / sd))) AS f FROM e, s, l)
SELECT instant, round(greatest(f * exp(least(b + w * (temp - m) / sd, cap)) - 1, 0), 2) AS cnt FROM demand, s, l, f WHERE dteday >= DATE '{CUT_DATE}'""")
def batch_scoring(spark, d):
    """Rows after the cut scored with statistics, weights, factor and cap of the rows before it."""
    from hourwise.operators.audit import date_cut
    from hourwise.operators.gram import normal_equations
    from hourwise.plans import solvers
    from hourwise.plans.design import Design
    from hourwise.plans.spec import DesignSpec
    from hourwise.sources.sinks import prediction_rows
    df = demand(spark, d)
    fit, new = date_cut(df, "dteday", CUT_DATE)
    t = PowerTarget(0.0, "ls")
    m = Design(DesignSpec(("temp",)), EPOCH).fit(fit)
    z = m.columns()["temp"]
    g, c, _ = normal_equations(fit, t.forward("cnt"), [z])
    w = solvers.least_squares(g, c, 0.0)
    eta = z * float(w[1]) + float(w[0])
    s = fit.agg(t.factor_column(eta, "cnt").alias("s"), F.max("cnt").alias("top")).first()
    out = scoring.score_rows(new, m, {"temp": float(w[1])}, float(w[0]), t, s["s"], t.cap(float(s["top"])))
    return prediction_rows(out, "instant", "pred")


@query("R4_plausibility_band", f"""WITH {DEMAND}, a AS (SELECT workingday, hr, avg(cnt) AS m FROM demand WHERE dteday >= DATE '{CUT_DATE}' GROUP BY ALL), b AS (SELECT workingday, hr, avg(cnt) AS m FROM demand WHERE dteday < DATE '{CUT_DATE}' GROUP BY ALL),
r AS (SELECT a.m / b.m AS ratio FROM a JOIN b USING (workingday, hr)) SELECT count(*)::BIGINT AS n_cells, count(*) FILTER (ratio < 0.4 OR ratio > 2.5)::BIGINT AS n_outside,
round(count(*) FILTER (ratio < 0.4 OR ratio > 2.5) / count(*)::DOUBLE, 6) AS share_outside, round(min(ratio), 6) AS min_ratio, round(max(ratio), 6) AS max_ratio FROM r""")
def plausibility_band(spark, d):
    """Cells whose mean after the cut is far from the mean before it."""
    from hourwise.operators.audit import date_cut
    early, late = date_cut(demand(spark, d), "dteday", CUT_DATE)
    return rounded(scoring.profile_check(late, early, ["workingday", "hr"], "cnt", "cnt"))
