"""Queries: filters, joins, group statistics, windows, top-k and set operations."""
from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from hourwise.functions import calendar as cal
from hourwise.operators import audit, profiles, quantiles, ranks
from hourwise.operators import timeline as tl
from hourwise.queries.base import (BASE_YEAR, CUT_DATE, DAILY, DEMAND, EPOCH, LABELLED, SEED, TIMELINE, daily, demand,
                                   hash_sql, labelled, query, r6, rounded, settled, timeline)
from hourwise.sources.tables import table

ORDERS_CUT = "2000-01-01"

# ----------------------------------------------------------------------------- filters


@query("F1_date_cut", f"""SELECT CASE WHEN o_orderdate < DATE '{ORDERS_CUT}' THEN 'early' ELSE 'late' END AS side,
count(*)::BIGINT AS n, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1""")
def date_cut(spark, d):
    """Rows before and from a date on."""
    o = table(spark, d, "orders", ["o_orderdate"]).select(F.to_date("o_orderdate").alias("d"))
    parts = [df.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.max("d").alias("last_day"))
             for side, df in zip(("early", "late"), audit.date_cut(o, "d", ORDERS_CUT))]
    return parts[0].unionByName(parts[1])


_FOLDED = f"{DEMAND}, days AS (SELECT dteday, CAST((dense_rank() OVER (ORDER BY dteday) - 1) % 5 AS INTEGER) AS fold " \
          "FROM (SELECT DISTINCT dteday FROM demand)), folded AS (SELECT * FROM demand JOIN days USING (dteday))"


@query("F2_fold_complement", f"""WITH {_FOLDED} SELECT f.f AS fold, count(*) FILTER (fold = f.f)::BIGINT AS n_held,
count(*) FILTER (fold <> f.f)::BIGINT AS n_fit, sum(cnt) FILTER (fold <> f.f)::BIGINT AS fit_cnt
FROM folded, (SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS f) f GROUP BY f.f""")
def fold_complement(spark, d):
    """Held fold against the rest: fold totals, then total minus fold, so the rows are read once."""
    from hourwise.operators.splits import day_folds
    per = day_folds(demand(spark, d), "dteday", 5).groupBy("fold").agg(F.count("*").alias("n_held"), F.sum("cnt").alias("c"))
    w = Window.partitionBy(F.lit(0))      # five rows
    return per.select("fold", "n_held", (F.sum("n_held").over(w) - F.col("n_held")).alias("n_fit"),
                      (F.sum("c").over(w) - F.col("c")).alias("fit_cnt"))


@query("F3_fault_rows", f"""WITH {DEMAND} SELECT count(*) FILTER (hum = 0)::BIGINT AS hum_zero, count(*) FILTER (windspeed = 0)::BIGINT
AS wind_zero, count(*) FILTER (abs(atemp - temp) > 0.2)::BIGINT AS temp_gap FROM demand""")
def fault_rows(spark, d):
    """Counts of readings that look like faults."""
    return audit.condition_counts(demand(spark, d), {"hum_zero": F.col("hum") == 0, "wind_zero": F.col("windspeed") == 0,
                                                     "temp_gap": F.abs(F.col("atemp") - F.col("temp")) > 0.2})


@query("F4_rush_and_night", f"""WITH {DEMAND} SELECT count(*) FILTER (hr IN (7, 8, 9, 16, 17, 18, 19) AND workingday = 1)::BIGINT AS rush,
count(*) FILTER (hr BETWEEN 0 AND 5)::BIGINT AS night FROM demand""")
def rush_and_night(spark, d):
    """Rush hours of working days, and hours 0 to 5."""
    return audit.condition_counts(demand(spark, d), {
        "rush": F.col("hr").isin(7, 8, 9, 16, 17, 18, 19) & (F.col("workingday") == 1), "night": F.col("hr").between(0, 5)})


@query("F5_minimum_cell_size", f"""WITH {DEMAND} SELECT entity, workingday, hr, count(*)::BIGINT AS n, round(avg(cnt), 6) AS mean_cnt
FROM demand GROUP BY ALL HAVING count(*) >= 5""")
def minimum_cell_size(spark, d):
    """Cells with enough rows."""
    return rounded(demand(spark, d).groupBy("entity", "workingday", "hr").agg(
        F.count("*").alias("n"), F.avg("cnt").alias("mean_cnt")).where("n >= 5"))


@query("F6_day_of_month_holdout", """SELECT CASE WHEN dayofmonth(o_orderdate) = 19 THEN 'held' ELSE 'fit' END AS side,
count(*)::BIGINT AS n FROM orders GROUP BY 1""")
def day_of_month_holdout(spark, d):
    """One day of the month held out."""
    o = table(spark, d, "orders", ["o_orderdate"])
    return o.groupBy(F.when(F.dayofmonth("o_orderdate") == 19, "held").otherwise("fit").alias("side")).agg(F.count("*").alias("n"))


@query("F7_calendar_rule_violations", f"""WITH {DEMAND} SELECT
 count(*) FILTER (weekday <> dayofweek(dteday))::BIGINT AS weekday_bad, count(*) FILTER (yr <> year(dteday) - {BASE_YEAR})::BIGINT AS yr_bad,
 count(*) FILTER (mnth <> month(dteday))::BIGINT AS mnth_bad, count(*) FILTER (season <> floor((mnth - 1) / 3.0) + 1)::BIGINT AS season_bad,
 count(*) FILTER (workingday <> CASE WHEN weekday BETWEEN 1 AND 5 AND holiday = 0 THEN 1 ELSE 0 END)::BIGINT AS workingday_bad,
 count(*) FILTER (holiday = 1 AND NOT weekday BETWEEN 1 AND 5)::BIGINT AS holiday_on_weekend FROM demand""")
def calendar_rules(spark, d):
    """Stored calendar columns against the date."""
    return audit.date_rule_violations(demand(spark, d), "dteday", BASE_YEAR)


@query("F8_output_contract", f"""WITH {DEMAND}, want AS (SELECT instant FROM demand WHERE dteday >= DATE '{CUT_DATE}'),
got AS (SELECT instant, round(temp * 50 - 1, 2) AS p FROM demand WHERE dteday > DATE '{CUT_DATE}'),
b AS (SELECT w.instant AS a, g.instant AS c, g.p FROM want w FULL JOIN got g USING (instant))
SELECT count(a)::BIGINT AS n_expected, count(c)::BIGINT AS n_given, count(*) FILTER (c IS NULL)::BIGINT AS n_missing,
count(*) FILTER (a IS NULL)::BIGINT AS n_unknown, 0::BIGINT AS n_repeated, count(*) FILTER (p < 0)::BIGINT AS n_negative,
0::BIGINT AS n_not_finite, max(abs(p)) = 0 AS all_zero FROM b""")
def output_contract(spark, d):
    """A prediction table with one day missing, checked against the rows it should answer."""
    df = demand(spark, d)
    want = df.where(F.col("dteday") >= F.lit(CUT_DATE).cast("date"))
    got = df.where(F.col("dteday") > F.lit(CUT_DATE).cast("date")).select("instant", F.round(F.col("temp") * 50 - 1, 2).alias("p"))
    return audit.output_contract(want, got, "instant", "p")


@query("F9_monotone_key", """WITH a AS (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events)
SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (ts < p)::BIGINT AS n_breaks, count(*) FILTER (ts < p) = 0 AS monotone FROM a""")
def monotone_key(spark, d):
    """Does key order equal time order?"""
    return tl.key_order_breaks(table(spark, d, "events", ["event_id", "ts"]), "event_id", "ts")


# ----------------------------------------------------------------------------- joins

@query("J1_timestamp_lookup", f"""WITH {TIMELINE} SELECT a.user_id, a.hour_idx, coalesce(b.weathersit, a.weathersit) AS lag2
FROM timeline a LEFT JOIN timeline b ON b.user_id = a.user_id AND b.hour_idx = a.hour_idx - 2""")
def timestamp_lookup(spark, d):
    """Self lookup two hours back, own value when absent."""
    df = timeline(spark, d)
    return tl.shifted(df, None, ["user_id"], {"lag2": ("weathersit", 2)}).select("user_id", "hour_idx", "lag2")


@query("J2_threshold_lookup", """WITH c AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.75) AS threshold
FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, max(threshold) AS threshold,
count(*) FILTER (l_quantity > threshold)::BIGINT AS n_above FROM lineitem JOIN c USING (l_returnflag, l_linestatus) GROUP BY ALL""")
def threshold_lookup(spark, d):
    """Rows joined to the threshold of their cell; a missing cell is an error."""
    rows = table(spark, d, "lineitem", ["l_returnflag", "l_linestatus", "l_quantity"])
    keys = ["l_returnflag", "l_linestatus"]
    cells = quantiles.grouped_quantiles(rows, keys, "l_quantity", {"threshold": 0.75})
    return audit.lookup_or_fail(rows, cells, keys, "threshold").groupBy(*keys).agg(
        F.max("threshold").alias("threshold"), F.sum((F.col("l_quantity") > F.col("threshold")).cast("bigint")).alias("n_above"))


@query("J3_key_join", """SELECT o_orderkey, o_orderpriority, count(*)::BIGINT AS n_lines, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def key_join(spark, d):
    """Per-key values joined to their inputs; lines are reduced per key before they meet the orders."""
    lines = (table(spark, d, "lineitem", ["l_orderkey", "l_quantity"]).groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
    return table(spark, d, "orders", ["o_orderkey", "o_orderpriority"]).join(lines, "o_orderkey")


@query("J4_semi_join_dates", f"""WITH {LABELLED}, t AS (SELECT DISTINCT dteday FROM labelled WHERE val = 0)
SELECT count(*)::BIGINT AS n_val, count(t.dteday)::BIGINT AS n_shared, round(count(t.dteday) / count(*)::DOUBLE, 6) AS share
FROM labelled l LEFT JOIN t USING (dteday) WHERE val = 1""")
def semi_join_dates(spark, d):
    """Held-out rows whose day also has fitting rows."""
    df = labelled(spark, d)
    flagged = audit.flag_in(df.where("val = 1"), df.where("val = 0"), {"dteday": F.col("dteday")}, "shared")
    return rounded(flagged.agg(F.count("*").alias("n_val"), F.sum("shared").alias("n_shared"), F.avg("shared").alias("share")))


@query("J5_adjacent_key_coverage", f"""WITH {LABELLED}, t AS (SELECT DISTINCT entity, hour_idx FROM labelled WHERE val = 0)
SELECT count(*)::BIGINT AS n_val, count(*) FILTER (p.hour_idx IS NOT NULL OR n.hour_idx IS NOT NULL)::BIGINT AS n_either,
count(*) FILTER (p.hour_idx IS NOT NULL AND n.hour_idx IS NOT NULL)::BIGINT AS n_both FROM labelled l
LEFT JOIN t p ON p.entity = l.entity AND p.hour_idx = l.hour_idx - 1 LEFT JOIN t n ON n.entity = l.entity AND n.hour_idx = l.hour_idx + 1
WHERE val = 1""")
def adjacent_keys(spark, d):
    """Held-out rows with the hour before or after among the fitting rows."""
    df = labelled(spark, d)
    fit = df.where("val = 0").select("entity", "hour_idx")
    one = audit.flag_in(df.where("val = 1"), fit, {"entity": F.col("entity"), "hour_idx": F.col("hour_idx") - 1}, "prev")
    two = audit.flag_in(one, fit, {"entity": F.col("entity"), "hour_idx": F.col("hour_idx") + 1}, "next")
    return two.agg(F.count("*").alias("n_val"), F.sum(F.greatest("prev", "next")).alias("n_either"),
                   F.sum(F.least("prev", "next")).alias("n_both"))


_MISSING = f"""{TIMELINE}, days AS (SELECT DISTINCT user_id, dteday FROM timeline),
miss AS (SELECT user_id, dteday, CAST(h AS INTEGER) AS hr FROM days CROSS JOIN (SELECT unnest(range(24)) AS h)
  EXCEPT SELECT user_id, dteday, hr FROM timeline)"""


@query("J6_missing_hours", f"WITH {_MISSING} SELECT user_id, dteday, hr FROM miss")
def missing_hours(spark, d):
    """Hours absent on days with any row."""
    return tl.missing_hours(timeline(spark, d), ["user_id"])


@query("J7_cell_ratio", f"""WITH {DEMAND}, a AS (SELECT workingday, hr, avg(cnt) AS m FROM demand WHERE dteday >= DATE '{CUT_DATE}' GROUP BY ALL),
b AS (SELECT workingday, hr, avg(cnt) AS m FROM demand WHERE dteday < DATE '{CUT_DATE}' GROUP BY ALL)
SELECT workingday, hr, round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, round(a.m / b.m, 6) AS ratio FROM a JOIN b USING (workingday, hr)""")
def cell_ratio(spark, d):
    """Mean after the cut over mean before it, per cell."""
    early, late = audit.date_cut(demand(spark, d), "dteday", CUT_DATE)
    return rounded(audit.cell_ratio(late, early, ["workingday", "hr"], "cnt", "cnt"))


@query("J8_day_size_map", f"""WITH {LABELLED}, s AS (SELECT dteday, count(*) AS n FROM labelled WHERE val = 0 GROUP BY dteday)
SELECT dteday, count(*)::BIGINT AS n_val, max(s.n)::BIGINT AS day_fit_rows, round(avg(s.n), 6) AS mean_rows
FROM labelled JOIN s USING (dteday) WHERE val = 1 GROUP BY dteday""")
def day_sizes(spark, d):
    """Each held-out row carries the size of its day among the fitting rows."""
    df = labelled(spark, d)
    sizes = df.where("val = 0").groupBy("dteday").agg(F.count("*").alias("s"))
    return rounded(df.where("val = 1").join(sizes, "dteday").groupBy("dteday").agg(
        F.count("*").alias("n_val"), F.max("s").alias("day_fit_rows"), F.avg("s").alias("mean_rows")))


@query("J9_weight_lift", """WITH w AS (SELECT n_name AS name, n_nationkey / 8.0::DOUBLE AS weight FROM nation WHERE n_regionkey = 1)
SELECT CAST(n_nationkey AS INTEGER) AS pos, n_name AS name, coalesce(weight, 0) AS weight, count(c_custkey)::BIGINT AS n_cust
FROM nation LEFT JOIN w ON w.name = n_name LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def weight_lift(spark, d):
    """Weights of a short name list placed in a longer one."""
    n = table(spark, d, "nation")
    small = n.where("n_regionkey = 1").select(F.col("n_name").alias("name"), (F.col("n_nationkey") / 8.0).alias("weight"))
    lifted = audit.lift_by_name(small, n.select(F.col("n_nationkey").cast("int").alias("pos"), F.col("n_name").alias("name")))
    per = table(spark, d, "customer", ["c_nationkey"]).groupBy(F.col("c_nationkey").cast("int").alias("pos")).agg(F.count("*").alias("n_cust"))
    return lifted.join(per, "pos", "left").select("pos", "name", "weight", F.coalesce("n_cust", F.lit(0)).cast("bigint").alias("n_cust"))


# ----------------------------------------------------------------------------- aggregations

@query("A1_table_profile", f"""WITH {TIMELINE} SELECT count(*)::BIGINT AS n_rows, count(DISTINCT dteday)::BIGINT AS n_days, min(dteday) AS first_day,
max(dteday) AS last_day, count(*) FILTER (cnt IS NULL OR cents IS NULL)::BIGINT AS n_null,
(SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT DISTINCT dayofmonth(dteday) AS x FROM timeline)) AS days_of_month FROM timeline""")
def table_profile(spark, d):
    """Rows, days, range, nulls."""
    return profiles.table_profile(timeline(spark, d), "dteday", ["cnt", "cents"])


@query("A2_numeric_summary", """SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS sd,
round(skewness(l_extendedprice), 4) AS skew, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75,
round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL""")
def numeric_summary(spark, d):
    """Moments and exact quantiles of a price."""
    rows = table(spark, d, "lineitem", ["l_returnflag", "l_extendedprice"])
    return rounded(profiles.numeric_summary(rows, "l_extendedprice", ["l_returnflag"]), 4)


def _pop_skew(e: str) -> str:
    return f"round(skewness({e}) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1.0::DOUBLE)), 6)"


@query("A3_population_skew", f"""SELECT {_pop_skew('value')} AS raw, {_pop_skew('sqrt(value + 1)')} AS root,
{_pop_skew('((value + 1) ** 0.1::DOUBLE - 1) / 0.1::DOUBLE')} AS power01, {_pop_skew('ln(1 + value)')} AS log1p FROM events""")
def population_skew(spark, d):
    """Skew of a measure and of its transforms."""
    v = F.col("value")
    return rounded(table(spark, d, "events", ["value"]).agg(
        F.skewness(v).alias("raw"), F.skewness(F.sqrt(v + 1)).alias("root"),
        F.skewness((F.pow(v + 1, F.lit(0.1)) - 1) / 0.1).alias("power01"), F.skewness(F.log1p(v)).alias("log1p")))


@query("A4_value_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def value_counts(spark, d):
    """Counts per category."""
    return table(spark, d, "events", ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("A5_pivoted_profile", f"""WITH {DEMAND} SELECT hr, round(avg(cnt) FILTER (workingday = 0), 6) AS wd_0,
round(avg(cnt) FILTER (workingday = 1), 6) AS wd_1 FROM demand GROUP BY hr""")
def pivoted_profile(spark, d):
    """Mean by hour, day types across."""
    return rounded(profiles.mean_pivot(demand(spark, d), "hr", "workingday", [0, 1], "cnt", "wd_"))


@query("A6_demand_profile", f"""WITH {DEMAND} SELECT workingday, hr, round(avg(cnt), 6) AS mean_cnt, count(*)::BIGINT AS n FROM demand GROUP BY ALL""")
def demand_profile(spark, d):
    """Mean per hour and day type."""
    return rounded(demand(spark, d).groupBy("workingday", "hr").agg(F.avg("cnt").alias("mean_cnt"), F.count("*").alias("n")))


@query("A7_growth_table", f"""WITH {DAILY}, m AS (SELECT yr, mnth, avg(cnt) AS m, avg(ln(cnt)) AS l FROM daily GROUP BY ALL)
SELECT b.yr, b.mnth, round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b, round(b.m / a.m, 6) AS ratio, round(b.l - a.l, 6) + 0.0 AS log_diff FROM m a JOIN m b ON b.mnth = a.mnth AND b.yr = a.yr + 1""")
def growth_table(spark, d):
    """Monthly means of every year and the year before, their ratio and the difference of mean logs."""
    means = daily(spark, d).groupBy("yr", "mnth").agg(F.avg("cnt").alias("m"), F.avg(F.log("cnt")).alias("l"))
    before = means.select((F.col("yr") + 1).alias("yr"), "mnth", F.col("m").alias("mean_a"), F.col("l").alias("l_a"))
    return rounded(means.join(before, ["yr", "mnth"]).select("yr", "mnth", "mean_a", F.col("m").alias("mean_b"), (F.col("m") / F.col("mean_a")).alias("ratio"),
                                                             (F.col("l") - F.col("l_a")).alias("log_diff")))


@query("A8_rate_over_groups", f"""WITH {TIMELINE}, g AS (SELECT user_id, dteday, count(*) AS n FROM timeline GROUP BY ALL)
SELECT user_id, count(*)::BIGINT AS n_days, count(*) FILTER (n < 24)::BIGINT AS short_days, min(n)::BIGINT AS min_rows, max(n)::BIGINT AS max_rows
FROM g GROUP BY user_id""")
def rate_over_groups(spark, d):
    """Days with fewer than 24 rows."""
    per_day = timeline(spark, d).groupBy("user_id", "dteday").agg(F.count("*").alias("n"))
    return per_day.groupBy("user_id").agg(F.count("*").alias("n_days"), F.sum((F.col("n") < 24).cast("bigint")).alias("short_days"),
                                          F.min("n").alias("min_rows"), F.max("n").alias("max_rows"))


@query("A9_day_summary", f"""WITH {DEMAND} SELECT entity, dteday, count(*)::BIGINT AS n, sum(cnt)::BIGINT AS total, arg_min(workingday, hr) AS wd,
max(weathersit) AS max_ws, round(avg(temp), 6) AS mean_temp FROM demand GROUP BY ALL""")
def day_summary(spark, d):
    """One row per day."""
    return rounded(demand(spark, d).groupBy("entity", "dteday").agg(
        F.count("*").alias("n"), F.sum("cnt").alias("total"), F.min_by("workingday", "hr").alias("wd"),
        F.max("weathersit").alias("max_ws"), F.avg("temp").alias("mean_temp")))


@query("A10_cell_noise_floor", f"""WITH {DEMAND}, c AS (SELECT entity, workingday, hr, least(weathersit, 3) AS ws, count(*) AS n, avg(cnt) AS m, var_pop(cnt) AS v
FROM demand GROUP BY ALL), t AS (SELECT var_pop(cnt) * count(*) AS t, count(*) AS nn FROM demand),
w AS (SELECT sum(n * v) AS w, count(*) AS k, count(*) FILTER (n = 1) AS s FROM c)
SELECT round(1 - w / t, 6) AS r2, round(CASE WHEN nn = k THEN 0 ELSE 1 - (w / (nn - k)) / (t / (nn - 1)) END, 6) AS r2_adjusted, k::BIGINT AS n_cells,
round(s / k::DOUBLE, 6) AS singleton_cell_share, round(s / nn::DOUBLE, 6) AS singleton_row_share FROM t, w""")
def noise_floor(spark, d):
    """How much of the variance cell means explain."""
    return rounded(profiles.cell_noise_floor(
        demand(spark, d), ["entity", "workingday", "hr", F.least("weathersit", F.lit(3)).alias("ws")], "cnt"))


@query("A11_mean_variance_law", f"""WITH {DEMAND}, c AS (SELECT avg(cnt) AS m, var_samp(cnt) AS v FROM demand GROUP BY entity, hr HAVING count(*) >= 5)
SELECT round(regr_slope(ln(v), ln(m)), 6) AS slope, round(1 - regr_slope(ln(v), ln(m)) / 2, 6) AS implied_power, count(*)::BIGINT AS n_cells
FROM c WHERE v > 0""")
def mean_variance(spark, d):
    """Slope of log variance on log mean."""
    return rounded(profiles.mean_variance_law(demand(spark, d), ["entity", "hr"], "cnt", 5))


@query("A12_simple_line", f"""WITH {DEMAND}, l AS (SELECT entity, regr_slope(atemp, temp) AS s, regr_intercept(atemp, temp) AS i FROM demand GROUP BY entity)
SELECT entity, round(max(s), 6) AS slope, round(max(i), 6) AS intercept, round(max(abs(atemp - i - s * temp)), 6) AS max_abs_resid
FROM demand JOIN l USING (entity) GROUP BY entity""")
def simple_line(spark, d):
    """One regressor per group, with the largest residual."""
    return rounded(profiles.simple_line(demand(spark, d), "atemp", "temp", ["entity"]))


_PAIRS = (("temp", "atemp"), ("temp", "hum"), ("hum", "windspeed"), ("cnt", "temp"), ("cnt", "hr"))


@query("A13_pairwise_correlation", f"WITH {DEMAND} SELECT " + ", ".join(f"round(corr({a}, {b}), 6) + 0.0 AS {a}_{b}" for a, b in _PAIRS) + " FROM demand")
def pairwise_correlation(spark, d):
    """Correlations of named pairs in one pass."""
    return rounded(demand(spark, d).agg(*[F.corr(a, b).alias(f"{a}_{b}") for a, b in _PAIRS]))


_MATRIX = ("temp", "atemp", "hum", "windspeed", "hr", "cnt")


@query("A13_correlation_matrix", f"WITH {DEMAND} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM demand"
                                                                      for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1:]))
def correlation_matrix(spark, d):
    """Every pair of the numeric columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(_MATRIX) for b in _MATRIX[i + 1:]]
    row = demand(spark, d).agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("all"))
    return rounded(row.select(F.inline("all")))


# prediction stand-in of the residual queries: the cell mean of the rows before the cut
_PRED = f"""{DEMAND}, cells AS (SELECT workingday, hr, avg(cnt) AS pred FROM demand WHERE dteday < DATE '{CUT_DATE}' GROUP BY ALL),
scored AS (SELECT *, pred - cnt AS e, ln(1 + pred) - ln(1 + cnt) AS le FROM demand JOIN cells USING (workingday, hr))"""


def scored(spark, d):
    df = demand(spark, d)
    cells = df.where(F.col("dteday") < F.lit(CUT_DATE).cast("date")).groupBy("workingday", "hr").agg(F.avg("cnt").alias("pred"))
    return (df.join(cells, ["workingday", "hr"]).withColumn("e", F.col("pred") - F.col("cnt"))
            .withColumn("le", F.log1p("pred") - F.log1p("cnt")))


@query("A14_residual_table", f"""WITH {_PRED} SELECT entity, hr, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM scored)::DOUBLE, 6) AS row_share,
round(avg(cnt), 6) AS mean_y, round(avg(e), 6) + 0.0 AS bias, round(sqrt(avg(e * e)), 6) AS rmse,
round(sum(e * e) / (SELECT sum(e * e) FROM scored), 6) AS sse_share, round(avg(le), 6) + 0.0 AS log_bias, round(sqrt(avg(le * le)), 6) AS log_rmse
FROM scored GROUP BY entity, hr""")
def residual_table(spark, d):
    """Bias, RMSE and error share per group."""
    return rounded(profiles.residual_table(scored(spark, d), ["entity", "hr"], "cnt", "e", "le"))


@query("A15_residual_profile", f"""WITH {_PRED} SELECT workingday, hr, round(avg(le), 6) + 0.0 AS mean_resid, count(*)::BIGINT AS n FROM scored GROUP BY ALL""")
def residual_profile(spark, d):
    """Mean residual per (day type, hour); the bins of a reading are W3."""
    return rounded(scored(spark, d).groupBy("workingday", "hr").agg(F.avg("le").alias("mean_resid"), F.count("*").alias("n")))


@query("A16_sum_ratio", f"""WITH {_PRED} SELECT dteday, round(sum(cnt) / sum(pred), 6) AS ratio FROM scored GROUP BY dteday""")
def sum_ratio(spark, d):
    """Observed over predicted per date."""
    return rounded(scored(spark, d).groupBy("dteday").agg((F.sum("cnt") / F.sum("pred")).alias("ratio")))


@query("A17_daily_total_vs_month", f"""WITH {DAILY}, norm AS (SELECT yr, mnth, avg(cents) AS m FROM daily WHERE dom < 20 GROUP BY ALL)
SELECT d, round(cents / m, 6) AS ratio FROM daily JOIN norm USING (yr, mnth) WHERE dom >= 20""")
def daily_total_vs_month(spark, d):
    """Totals of later days over the mean daily total of the same month."""
    days = daily(spark, d)
    norm = days.where("dom < 20").groupBy("yr", "mnth").agg(F.avg("cents").alias("m"))
    return rounded(days.where("dom >= 20").join(norm, ["yr", "mnth"]).select("d", (F.col("cents") / F.col("m")).alias("ratio")))


@query("A18_prediction_summary", f"""WITH {_PRED} SELECT round(avg(pred), 6) AS mean, round(quantile_cont(pred, 0.5), 6) AS median, round(min(pred), 6) AS min,
round(max(pred), 6) AS max, count(*) FILTER (pred < 2)::BIGINT AS n_below, count(*) FILTER (pred - 2 < 0)::BIGINT AS n_clipped FROM scored""")
def prediction_summary(spark, d):
    """Location, range and clipped rows of the predictions."""
    df = scored(spark, d)
    median, = quantiles.quantile_values(df, "pred", [0.5])
    return rounded(df.agg(F.avg("pred").alias("mean"), F.max(F.lit(median)).alias("median"), F.min("pred").alias("min"), F.max("pred").alias("max"),
                          F.sum((F.col("pred") < 2).cast("bigint")).alias("n_below"),
                          F.sum((F.col("pred") - 2 < 0).cast("bigint")).alias("n_clipped")))


@query("A19_model_agreement", f"""WITH {_PRED}, m AS (SELECT avg(cnt) AS b FROM demand), x AS (SELECT pred AS a, pred * 0.9::DOUBLE + 0.1::DOUBLE * b + temp AS b FROM scored, m)
SELECT round(corr(a, b), 6) AS corr, round(avg(b) / avg(a), 6) AS mean_ratio, round(max(abs(a - b)), 6) AS max_abs_diff, round(avg(abs(a - b)), 6) AS mean_abs_diff FROM x""")
def model_agreement(spark, d):
    """How far two predictions are apart."""
    df = scored(spark, d)
    b = demand(spark, d).agg(F.avg("cnt")).first()[0]
    x = df.select(F.col("pred").alias("a"), (F.col("pred") * 0.9 + 0.1 * b + F.col("temp")).alias("b"))
    return rounded(agreement(x, "a", "b"))


def agreement(df, a, b):
    gap = F.abs(F.col(a) - F.col(b))
    return df.agg(F.corr(a, b).alias("corr"), (F.avg(b) / F.avg(a)).alias("mean_ratio"), F.max(gap).alias("max_abs_diff"),
                  F.avg(gap).alias("mean_abs_diff"))


@query("A20_mean_shift_per_cell", f"""WITH {_PRED} SELECT workingday, hr, round(avg(pred), 6) AS mean_a, round(avg(pred + temp), 6) AS mean_b FROM scored GROUP BY ALL""")
def mean_shift(spark, d):
    """Mean of two predictions per cell."""
    return rounded(scored(spark, d).groupBy("workingday", "hr").agg(F.avg("pred").alias("mean_a"), F.avg(F.col("pred") + F.col("temp")).alias("mean_b")))


@query("A21_class_balance", """SELECT o_orderpriority AS part, round(avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END), 6) AS positive,
round(greatest(avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END), 1 - avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END)), 6) AS majority
FROM orders GROUP BY 1 UNION ALL SELECT 'all', round(avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END), 6),
round(greatest(avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END), 1 - avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END)), 6) FROM orders""")
def class_balance(spark, d):
    """Positive share per part and overall, with the accuracy of the majority class."""
    o = table(spark, d, "orders", ["o_orderpriority", "o_totalprice"])
    per = o.groupBy(F.col("o_orderpriority").alias("part")).agg(
        F.sum((F.col("o_totalprice") > 250000).cast("bigint")).alias("p"), F.count("*").alias("n"))
    both = per.unionByName(per.agg(F.lit("all").alias("part"), F.sum("p").alias("p"), F.sum("n").alias("n")))
    share = F.col("p") / F.col("n")
    return rounded(both.select("part", share.alias("positive"), F.greatest(share, 1 - share).alias("majority")))


@query("A22_range_comparison", f"""WITH {DEMAND} SELECT CASE WHEN dteday < DATE '{CUT_DATE}' THEN 'early' ELSE 'late' END AS side, u.name AS name,
round(min(u.v), 6) AS lo, round(max(u.v), 6) AS hi FROM demand,
LATERAL (SELECT unnest(['temp', 'hum', 'windspeed']) AS name, unnest([temp, hum, windspeed]) AS v) u GROUP BY ALL""")
def range_comparison(spark, d):
    """Smallest and largest value per column and side: one aggregate row per side, then unpivoted."""
    names = ("temp", "hum", "windspeed")
    side = F.when(F.col("dteday") < F.lit(CUT_DATE).cast("date"), "early").otherwise("late")
    agg = demand(spark, d).groupBy(side.alias("side")).agg(*[f(n).alias(f"{n}_{t}") for n in names for f, t in ((F.min, "lo"), (F.max, "hi"))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi")) for n in names]))
    return rounded(agg.select("side", rows.alias("r")).select("side", "r.*"))


@query("A23_concentration", """WITH m AS (SELECT avg(CAST(round(value * 100) AS BIGINT)) AS m FROM events),
v AS (SELECT (CAST(round(value * 100) AS BIGINT) - m) ** 2 AS v FROM events, m), r AS (SELECT v, row_number() OVER (ORDER BY v DESC) AS k FROM v)
SELECT round(sum(v) FILTER (k <= ceil((SELECT count(*) FROM v) * 0.1)) / sum(v), 6) AS share, count(*) FILTER (k <= ceil((SELECT count(*) FROM v) * 0.1))::BIGINT AS n_top FROM r""")
def concentration(spark, d):
    """Share of the squared deviation in the top tenth of rows."""
    ev = table(spark, d, "events", ["value"]).select(F.round(F.col("value") * 100).cast("bigint").alias("c"))
    mean = ev.agg(F.avg("c")).first()[0]
    return rounded(profiles.top_share(ev, F.pow(F.col("c") - mean, F.lit(2.0)), 0.1))


@query("A24_zero_contrast", f"""WITH {DEMAND}, g AS (SELECT entity, workingday, avg(ln(1 + cnt)) FILTER (windspeed = 0) AS a,
avg(ln(1 + cnt)) FILTER (windspeed > 0) AS b FROM demand GROUP BY ALL) SELECT round(avg(a - b), 6) AS contrast, count(a - b)::BIGINT AS n_cells FROM g""")
def zero_contrast(spark, d):
    """Log mean at a zero reading minus the rest, inside cells."""
    g = demand(spark, d).groupBy("entity", "workingday").agg(
        F.avg(F.when(F.col("windspeed") == 0, F.log1p("cnt"))).alias("a"), F.avg(F.when(F.col("windspeed") > 0, F.log1p("cnt"))).alias("b"))
    gap = F.col("a") - F.col("b")
    return rounded(g.agg(F.avg(gap).alias("contrast"), F.count(gap).alias("n_cells")))


@query("A25_threshold_pivot", f"""WITH {DEMAND} SELECT entity, workingday, """ + ", ".join(
    f"round(quantile_cont(cnt, 0.75) FILTER (hr = {h}), 6) AS hr_{h}" for h in (8, 13, 17)) + " FROM demand WHERE hr IN (8, 13, 17) GROUP BY ALL")
def threshold_pivot(spark, d):
    """Thresholds at chosen hours, hours across."""
    keys = ["entity", "workingday", "hr"]
    t = quantiles.grouped_quantiles(demand(spark, d).where(F.col("hr").isin(8, 13, 17)), keys, "cnt", {"threshold": 0.75})
    wide = t.groupBy("entity", "workingday").pivot("hr", [8, 13, 17]).agg(F.max("threshold"))
    return rounded(wide.withColumnsRenamed({str(h): f"hr_{h}" for h in (8, 13, 17)}))


@query("A26_bias_and_drift", f"""WITH {_PRED}, l AS (SELECT avg(pred) AS p, avg(cnt) AS y FROM scored WHERE dteday >= DATE '{CUT_DATE}')
SELECT round((SELECT avg(cnt) FROM scored WHERE dteday < DATE '{CUT_DATE}'), 6) AS mean_early, round(max(y), 6) AS mean_late, round(max(p / y), 6) AS mean_ratio,
round(1 - sum((cnt - pred) ** 2) / (var_pop(cnt) * count(*)), 6) AS r2,
round(1 - sum((cnt - pred * y / p) ** 2) / (var_pop(cnt) * count(*)), 6) AS r2_level_corrected FROM scored, l WHERE dteday >= DATE '{CUT_DATE}'""")
def bias_and_drift(spark, d):
    """Level drift after the cut and the R2 with the level corrected."""
    from hourwise.operators import metrics
    df = scored(spark, d)
    early, late = audit.date_cut(df, "dteday", CUT_DATE)
    m = late.agg(F.avg("pred").alias("p"), F.avg("cnt").alias("y")).first()
    e = early.agg(F.avg("cnt")).first()[0]
    fixed = F.col("pred") * (m["y"] / m["p"])
    return rounded(late.agg(F.max(F.lit(e)).alias("mean_early"), F.avg("cnt").alias("mean_late"), (F.avg("pred") / F.avg("cnt")).alias("mean_ratio"),
                            metrics.r2("cnt", "pred").alias("r2"), metrics.r2("cnt", fixed).alias("r2_level_corrected")))


@query("A27_split_description", f"WITH {LABELLED} SELECT val, count(*)::BIGINT AS n, round(avg(cnt), 6) AS mean_cnt FROM labelled GROUP BY val")
def split_description(spark, d):
    """Rows and mean label per side."""
    return rounded(labelled(spark, d).groupBy("val").agg(F.count("*").alias("n"), F.avg("cnt").alias("mean_cnt")))


@query("A28_conditional_statistics", f"""WITH {DEMAND}, z AS (SELECT DISTINCT dteday FROM demand WHERE hum = 0)
SELECT round(quantile_cont(hum, 0.5) FILTER (hum > 0), 6) AS median_pos, round(quantile_cont(hum, 0.5) FILTER (hum > 0 AND weathersit >= 3), 6) AS median_ws3,
round(min(hum) FILTER (hum > 0), 6) AS min_pos, round(avg(hum) FILTER (dteday IN (SELECT dteday + 1 FROM z) OR dteday IN (SELECT dteday - 1 FROM z)), 6) AS near_fault
FROM demand""")
def conditional_statistics(spark, d):
    """Statistics under a predicate, and on the days next to a fault day."""
    df = demand(spark, d)
    pos = df.where("hum > 0")
    both = pos.select("hum", F.explode(F.when(F.col("weathersit") >= 3, F.array(F.lit("all"), F.lit("bad"))).otherwise(F.array(F.lit("all")))).alias("part"))
    medians = {r["part"]: r["m"] for r in quantiles.grouped_quantiles(both, ["part"], "hum", {"m": 0.5}).collect()}
    days = df.where("hum = 0").select("dteday").distinct()
    near = days.select(F.explode(F.array(F.date_add("dteday", 1), F.date_add("dteday", -1))).alias("dteday")).distinct().withColumn("near", F.lit(1))
    out = df.join(near, "dteday", "left").agg(F.min(F.when(F.col("hum") > 0, F.col("hum"))).alias("min_pos"),
                                              F.avg(F.when(F.col("near") == 1, F.col("hum"))).alias("near_fault"))
    return rounded(out.select(F.lit(medians["all"]).alias("median_pos"), F.lit(medians.get("bad")).cast("double").alias("median_ws3"), "min_pos", "near_fault"))


@query("A29_low_counts_and_levels", f"""WITH {DEMAND} SELECT hr, round(avg(CASE WHEN cnt <= 2 THEN 1.0 ELSE 0 END), 6) AS low_share, count(*) FILTER (cnt = 1)::BIGINT AS n_one,
round(avg(CASE WHEN windspeed = 0 THEN 1.0 ELSE 0 END), 6) AS zero_share,
(SELECT string_agg(CAST(w AS VARCHAR), ',' ORDER BY w) FROM (SELECT DISTINCT CAST(round(windspeed * 1000) AS BIGINT) AS w FROM demand ORDER BY w LIMIT 4)) AS lowest
FROM demand GROUP BY hr""")
def low_counts(spark, d):
    """Low-count share by hour and the lowest distinct levels of a reading."""
    df = demand(spark, d)
    lowest = [r[0] for r in df.select(F.round(F.col("windspeed") * 1000).cast("bigint").alias("w")).distinct().orderBy("w").limit(4).collect()]
    return rounded(df.groupBy("hr").agg(F.avg((F.col("cnt") <= 2).cast("double")).alias("low_share"), F.sum((F.col("cnt") == 1).cast("bigint")).alias("n_one"),
                                        F.avg((F.col("windspeed") == 0).cast("double")).alias("zero_share"))
                   .withColumn("lowest", F.lit(",".join(map(str, lowest)))))


@query("A30_first_of_group", f"""WITH {DEMAND}, g AS (SELECT entity, dteday, arg_min(weekday, hr) AS weekday, arg_min(workingday, hr) AS wd FROM demand GROUP BY ALL)
SELECT weekday, count(*)::BIGINT AS n_days, sum(wd)::BIGINT AS working_days FROM g GROUP BY weekday""")
def first_of_group(spark, d):
    """One attribute per day, then counted."""
    g = demand(spark, d).groupBy("entity", "dteday").agg(F.min_by("weekday", "hr").alias("weekday"), F.min_by("workingday", "hr").alias("wd"))
    return g.groupBy("weekday").agg(F.count("*").alias("n_days"), F.sum("wd").alias("working_days"))


# ----------------------------------------------------------------------------- windows

@query("W1_group_stats_on_rows", f"""WITH {DEMAND} SELECT instant, round(cnt - avg(cnt) OVER w, 6) + 0.0 AS dev, (count(*) OVER w)::BIGINT AS g_n,
round(quantile_cont(cnt, 0.5) OVER w, 6) AS g_median FROM demand WINDOW w AS (PARTITION BY entity, workingday, hr)""")
def group_stats(spark, d):
    """Cell mean, size and median on every row."""
    out = profiles.with_group_stats(demand(spark, d), ["entity", "workingday", "hr"], "cnt", median=True)
    return rounded(out.select("instant", (F.col("cnt") - F.col("g_mean")).alias("dev"), "g_n", "g_median"))


@query("W2_date_rank_folds", f"WITH {_FOLDED} SELECT dteday, fold, count(*)::BIGINT AS n FROM folded GROUP BY ALL")
def date_rank_folds(spark, d):
    """Fold of a date from its rank among the dates."""
    from hourwise.operators.splits import day_folds
    return day_folds(demand(spark, d), "dteday", 5).groupBy("dteday", "fold").agg(F.count("*").alias("n"))


@query("W3_equal_count_bins", f"""WITH {_PRED}, b AS (SELECT temp, le, CAST(ntile(10) OVER (ORDER BY temp, instant) AS INTEGER) AS bin FROM scored)
SELECT bin, round(min(temp), 6) AS lo, round(max(temp), 6) AS hi, round(avg(le), 6) + 0.0 AS mean_resid, count(*)::BIGINT AS n FROM b GROUP BY bin""")
def equal_count_bins(spark, d):
    """Ten equal-count bins of a reading with the mean residual of each."""
    return rounded(ranks.bin_summary(ranks.equal_count_bins(scored(spark, d).select("instant", "temp", "le"), "temp", "instant", 10), "temp", "le"))


@query("W4_quantile_deciles", """WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS q FROM lineitem)
SELECT CAST(len(list_filter(q, lambda x: l_extendedprice > x)) AS INTEGER) AS decile, count(*)::BIGINT AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi
FROM lineitem, e GROUP BY 1""")
def quantile_deciles(spark, d):
    """Deciles between exact quantile edges."""
    rows = table(spark, d, "lineitem", ["l_extendedprice"])
    return quantiles.quantile_bins(rows, "l_extendedprice", 10, "decile").groupBy("decile").agg(
        F.count("*").alias("n"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("W5_average_rank", """SELECT l_quantity, count(*)::BIGINT AS n, min(r) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank FROM
(SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY l_quantity""")
def average_rank(spark, d):
    """Mean rank of tied values."""
    return ranks.average_ranks(table(spark, d, "lineitem", ["l_quantity"]), "l_quantity")


@query("W6_cumulative_counts", """WITH h AS (SELECT n_chars, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS q
FROM documents JOIN labels USING (doc_id) GROUP BY n_chars)
SELECT n_chars, (sum(p) OVER (ORDER BY n_chars DESC))::BIGINT AS tp, (sum(q) OVER (ORDER BY n_chars DESC))::BIGINT AS fp FROM h""")
def cumulative_counts(spark, d):
    """True and false positives at every distinct score."""
    rows = table(spark, d, "documents", ["doc_id", "n_chars"]).join(table(spark, d, "labels", ["doc_id", "quality"]), "doc_id")
    return ranks.cumulative_counts(rows, "n_chars", "quality").select("n_chars", "tp", "fp")


@query("W7_missing_hour_runs", f"""WITH {_MISSING}, g AS (SELECT *, hr - row_number() OVER (PARTITION BY user_id, dteday ORDER BY hr) AS i FROM miss)
SELECT user_id, dteday, min(hr) AS first_hr, max(hr) AS last_hr, count(*)::BIGINT AS n_hours FROM g GROUP BY user_id, dteday, i""")
def missing_hour_runs(spark, d):
    """Gaps and islands inside a day."""
    return tl.missing_runs(tl.missing_hours(timeline(spark, d), ["user_id"]), ["user_id"])


@query("W8_flag_run_lengths", f"""WITH {DEMAND}, g AS (SELECT entity, windspeed = 0 AS f, row_number() OVER (PARTITION BY entity ORDER BY hour_idx)
- row_number() OVER (PARTITION BY entity, windspeed = 0 ORDER BY hour_idx) AS i FROM demand), r AS (SELECT entity, count(*) AS n FROM g WHERE f GROUP BY entity, i)
SELECT entity, count(*)::BIGINT AS n_runs, quantile_cont(n, 0.5)::DOUBLE AS median, max(n)::BIGINT AS max, round(sum(n) FILTER (n >= 3) / sum(n)::DOUBLE, 6) AS share_3
FROM r GROUP BY entity""")
def flag_run_lengths(spark, d):
    """Runs of a zero reading: count, median, longest and the share in long runs."""
    runs = tl.flag_runs(demand(spark, d), ["entity"], F.col("windspeed") == 0)
    med = quantiles.grouped_quantiles(runs, ["entity"], "n", {"median": 0.5}).drop("n")
    stats = runs.groupBy("entity").agg(F.count("*").alias("n_runs"), F.max("n").alias("max"),
                                       (F.sum(F.when(F.col("n") >= 3, F.col("n"))) / F.sum("n")).alias("share_3"))
    return rounded(stats.join(med, "entity"))


@query("W9_rows_next_to_gap", f"""WITH {TIMELINE}, a AS (SELECT *, lag(hr) OVER w AS p, lead(hr) OVER w AS q FROM timeline WINDOW w AS (PARTITION BY user_id, dteday ORDER BY hr))
SELECT user_id, count(*) FILTER ((hr > 0 AND coalesce(p, -9) <> hr - 1) OR (hr < 23 AND coalesce(q, 99) <> hr + 1))::BIGINT AS n_adjacent, count(*)::BIGINT AS n
FROM a GROUP BY user_id""")
def rows_next_to_gap(spark, d):
    """Rows beside a missing hour."""
    return tl.next_to_gap(timeline(spark, d), ["user_id"]).groupBy("user_id").agg(
        F.sum("adjacent").alias("n_adjacent"), F.count("*").alias("n"))


@query("W10_day_variance_share", f"""WITH {_PRED}, a AS (SELECT e, avg(e) OVER (PARTITION BY dteday) AS m, count(*) OVER (PARTITION BY dteday) AS n, dteday FROM scored)
SELECT round(var_pop(m) / var_pop(e), 6) AS variance_share, round(sum(m * m) / sum(e * e), 6) AS square_share, count(*)::BIGINT AS rows_used,
count(DISTINCT dteday)::BIGINT AS n_groups FROM a WHERE n >= 3""")
def day_variance_share(spark, d):
    """Share of the residual that whole days have in common."""
    return rounded(profiles.group_variance_share(scored(spark, d), ["dteday"], "e", 3))


@query("W11_competition_rank", """WITH e AS (SELECT p_brand AS name, max(p_retailprice) FILTER (p_size > 49) AS entry FROM part GROUP BY 1)
SELECT name, CASE WHEN entry IS NULL THEN NULL ELSE (1 + (SELECT count(*) FROM e b WHERE b.entry > e.entry))::INTEGER END AS entry_rank FROM e""")
def competition_rank(spark, d):
    """Ties share the better rank; a column that never enters has none."""
    from hourwise.operators.selection import entry_ranks
    e = table(spark, d, "part", ["p_brand", "p_retailprice", "p_size"]).groupBy(F.col("p_brand").alias("name")).agg(
        F.max(F.when(F.col("p_size") > 49, F.col("p_retailprice"))).alias("entry"))
    return entry_ranks(e, "entry").select("name", "entry_rank")


# ----------------------------------------------------------------------------- top-k

@query("O1_top_hours", f"""WITH {DEMAND}, p AS (SELECT workingday, hr, sum(cnt)::BIGINT AS total FROM demand GROUP BY ALL)
SELECT workingday, hr, total, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY workingday ORDER BY total DESC, hr) AS INTEGER) AS rank FROM p) WHERE rank <= 3""")
def top_hours(spark, d):
    """Three busiest hours per day type."""
    p = demand(spark, d).groupBy("workingday", "hr").agg(F.sum("cnt").alias("total"))
    return profiles.top_per_group(p, ["workingday"], [F.desc("total"), F.asc("hr")], 3)


@query("O2_worst_days", f"""WITH {_PRED}, g AS (SELECT dteday, round(sum(e * e), 6) AS sse, round(avg(e), 6) + 0.0 AS bias, count(*)::BIGINT AS n FROM scored GROUP BY dteday)
SELECT dteday, sse, bias, n, round(sse / sum(sse) OVER (), 6) AS sse_share FROM g ORDER BY sse DESC, dteday LIMIT 10""")
def worst_days(spark, d):
    """Days with the largest squared error."""
    g = rounded(scored(spark, d).groupBy("dteday").agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.avg("e").alias("bias"), F.count("*").alias("n")))
    share = F.col("sse") / F.sum("sse").over(Window.partitionBy(F.lit(0)))     # one row per date
    return g.withColumn("sse_share", r6(share)).orderBy(F.desc("sse"), "dteday").limit(10)


@query("O3_lowest_days", f"""WITH {DAILY}, m AS (SELECT yr, mnth, quantile_cont(cents, 0.5) AS ref FROM daily GROUP BY ALL)
SELECT d, cents, round(cents / ref, 6) AS ratio FROM daily JOIN m USING (yr, mnth) ORDER BY round(cents / ref, 6), d LIMIT 10""")
def lowest_days(spark, d):
    """Days far below the median day of their month."""
    days = daily(spark, d)
    ref = quantiles.grouped_quantiles(days, ["yr", "mnth"], "cents", {"ref": 0.5}).drop("n")
    return days.join(ref, ["yr", "mnth"]).select("d", "cents", r6(F.col("cents") / F.col("ref")).alias("ratio")).orderBy("ratio", "d").limit(10)


@query("O4_largest_coefficients", """SELECT s_suppkey, s_acctbal FROM supplier ORDER BY abs(s_acctbal) DESC, s_suppkey LIMIT 15""")
def largest_coefficients(spark, d):
    """Largest absolute values, ties in the given order."""
    return table(spark, d, "supplier", ["s_suppkey", "s_acctbal"]).orderBy(F.desc(F.abs("s_acctbal")), "s_suppkey").limit(15)


@query("O5_argmax_with_ties", """WITH g AS (SELECT p_brand, p_size, count(*)::BIGINT AS score FROM part GROUP BY ALL), m AS (SELECT p_brand, max(score) AS best FROM g GROUP BY p_brand)
SELECT p_brand, max(best)::BIGINT AS best, max(p_size) FILTER (score = best) AS exact_tie, max(p_size) FILTER (score >= best - 1) AS near_tie,
min(p_size) FILTER (score >= best - 1) AS smallest FROM g JOIN m USING (p_brand) GROUP BY p_brand""")
def argmax_with_ties(spark, d):
    """Best score; exact ties take the larger setting, near ties the larger or the smallest."""
    from hourwise.operators.selection import pick_setting
    g = table(spark, d, "part", ["p_brand", "p_size"]).groupBy("p_brand", "p_size").agg(F.count("*").alias("score"))
    return pick_setting(g, ["p_brand"], "score", "p_size", 1)


@query("O6_first_within_tolerance", """WITH g AS (SELECT p_brand, p_size, max(p_retailprice) AS score FROM part GROUP BY ALL), m AS (SELECT p_brand, max(score) AS best FROM g GROUP BY 1)
SELECT p_brand, min(p_size) AS level FROM g JOIN m USING (p_brand) WHERE score >= best - 150 GROUP BY p_brand""")
def first_within_tolerance(spark, d):
    """Simplest level within a tolerance of the best."""
    from hourwise.operators.selection import first_within
    g = table(spark, d, "part", ["p_brand", "p_size", "p_retailprice"]).groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("score"))
    return first_within(g, ["p_brand"], "score", "p_size", 150.0).withColumnRenamed("p_size", "level")


# ----------------------------------------------------------------------------- sets

@query("U1_union_by_columns", """SELECT o_orderdate::DATE AS d, 'order' AS kind, count(*)::BIGINT AS n FROM orders GROUP BY ALL
UNION ALL SELECT l_shipdate::DATE, 'ship', count(*)::BIGINT FROM lineitem GROUP BY ALL""")
def union_by_columns(spark, d):
    """Rows of two tables in one, matched by column name."""
    a = table(spark, d, "orders", ["o_orderdate"]).select(F.to_date("o_orderdate").alias("d"), F.lit("order").alias("kind"))
    b = table(spark, d, "lineitem", ["l_shipdate"]).select(F.lit("ship").alias("kind"), F.to_date("l_shipdate").alias("d"))
    return a.unionByName(b).groupBy("d", "kind").agg(F.count("*").alias("n"))


@query("U2_keep_first", """SELECT user_id, CAST(ts AS DATE) AS dteday, CAST(hour(ts) AS INTEGER) AS hr, arg_min(event_type, event_id) AS event_type,
min(event_id)::BIGINT AS event_id FROM events GROUP BY 1, 2, 3""")
def keep_first(spark, d):
    """First row of every repeated timestamp, without sorting any group."""
    ev = table(spark, d, "events", ["user_id", "ts", "event_type", "event_id"]).select(
        "user_id", F.to_date("ts").alias("dteday"), F.hour("ts").alias("hr"), "event_type", "event_id")
    return ev.groupBy("user_id", "dteday", "hr").agg(F.min_by("event_type", "event_id").alias("event_type"), F.min("event_id").alias("event_id"))


@query("U3_distinct_dates", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem")
def distinct_dates(spark, d):
    """Sorted unique dates."""
    return table(spark, d, "lineitem", ["l_shipdate"]).select(F.to_date("l_shipdate").alias("d")).distinct().orderBy("d")


@query("U4_set_difference", """SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def set_difference(spark, d):
    """Dates of one table that the other does not have."""
    a = table(spark, d, "lineitem", ["l_shipdate"]).select(F.to_date("l_shipdate").alias("d")).distinct()
    b = table(spark, d, "orders", ["o_orderdate"]).select(F.to_date("o_orderdate").alias("d")).distinct()
    return a.join(b, "d", "left_anti")


@query("U5_overlap_count", """SELECT count(*)::BIGINT AS n FROM (SELECT CAST(l_shipdate AS DATE) FROM lineitem INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def overlap_count(spark, d):
    """Days two tables share."""
    a = table(spark, d, "lineitem", ["l_shipdate"]).select(F.to_date("l_shipdate").alias("d")).distinct()
    b = table(spark, d, "orders", ["o_orderdate"]).select(F.to_date("o_orderdate").alias("d")).distinct()
    return a.intersect(b).agg(F.count("*").alias("n"))
