"""Queries: sources, sinks and feature columns."""
from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourwise.functions import calendar as cal
from hourwise.functions import target as tg
from hourwise.operators import timeline as tl
from hourwise.operators.quantiles import quantile_values
from hourwise.queries.base import CUT_DATE, DEMAND, EPOCH, TIMELINE, demand, query, r6, rolled_demand, rounded, timeline
from hourwise.session import shared_folder
from hourwise.sources import sinks
from hourwise.sources import tables as src

# ----------------------------------------------------------------------------- sources and sinks


@query("S1_labelled_scan", f"""WITH {TIMELINE}, k AS (SELECT *, least(weathersit, 3) AS ws FROM timeline)
SELECT a.user_id, a.hour_idx, a.cnt, coalesce(l1.ws, a.ws) AS ws_lag1,
  greatest(coalesce(l1.ws, a.ws), coalesce(l2.ws, a.ws), coalesce(l3.ws, a.ws)) AS wet3
FROM k a LEFT JOIN k l1 ON l1.user_id = a.user_id AND l1.hour_idx = a.hour_idx - 1
LEFT JOIN k l2 ON l2.user_id = a.user_id AND l2.hour_idx = a.hour_idx - 2
LEFT JOIN k l3 ON l3.user_id = a.user_id AND l3.hour_idx = a.hour_idx - 3""")
def labelled_scan(spark, d):
    """Typed labelled table with the memory columns attached."""
    df = timeline(spark, d).withColumn("instant", F.col("hour_idx"))
    return tl.weather_memory(df, keys=["user_id"], unique=True).select("user_id", "hour_idx", "cnt", "ws_lag1", "wet3")


@query("S2_pruned_timeline", """SELECT CAST(o_orderdate AS DATE) AS dteday, o_orderstatus, CAST(count(*) AS BIGINT) AS n
FROM orders GROUP BY 1, 2""")
def pruned_timeline(spark, d):
    """Only the key and context columns are read; the price column never leaves the file."""
    slim = src.timeline_scan(src.table(spark, d, "orders"), columns=["o_orderdate", "o_orderstatus"])
    return slim.groupBy(F.to_date("o_orderdate").alias("dteday"), "o_orderstatus").agg(F.count("*").alias("n"))


@query("S3_scoring_scan_joint_timeline", f"""WITH {TIMELINE}, k AS (SELECT *, least(weathersit, 3) AS ws FROM timeline)
SELECT a.user_id, a.hour_idx, coalesce(l1.ws, a.ws) AS ws_lag1 FROM k a
LEFT JOIN k l1 ON l1.user_id = a.user_id AND l1.hour_idx = a.hour_idx - 1
WHERE a.dteday >= DATE '{CUT_DATE}'""")
def scoring_scan(spark, d):
    """The scoring rows see the last hours of the labelled rows, but never their label."""
    df = timeline(spark, d).withColumn("instant", F.col("hour_idx"))
    columns = ["hour_idx", "instant", "weathersit"]
    scoring = df.where(F.col("dteday") >= F.lit(CUT_DATE).cast("date")).drop("cnt")
    known = df.where(F.col("dteday") < F.lit(CUT_DATE).cast("date"))
    both = (src.timeline_scan(known, ["user_id"], columns).withColumn("origin", F.lit(0))
            .unionByName(src.timeline_scan(scoring, ["user_id"], columns).withColumn("origin", F.lit(1))))
    return tl.weather_memory(scoring, both, ["user_id"], order="origin").select("user_id", "hour_idx", "ws_lag1")


@query("S4_hourly_rollup", f"""WITH {DEMAND} SELECT entity, hour_idx, instant, dteday, hr, season, yr, mnth, holiday, weekday,
workingday, weathersit, cnt, round(temp, 6) AS temp, round(atemp, 6) AS atemp, round(hum, 6) AS hum,
round(windspeed, 6) AS windspeed FROM demand""")
def hourly(spark, d):
    """Events to hourly demand."""
    return rounded(rolled_demand(spark, d).select("entity", "hour_idx", "instant", "dteday", "hr", "season", "yr", "mnth", "holiday",
                                           "weekday", "workingday", "weathersit", "cnt", "temp", "atemp", "hum", "windspeed"))


@query("S5_prediction_rows", f"WITH {DEMAND} SELECT instant, round(temp * 20, 2) AS cnt FROM demand")
def prediction_rows(spark, d):
    """Key and rounded prediction, written and read back."""
    scored = demand(spark, d).select("instant", (F.col("temp") * 20).alias("pred"))
    path = shared_folder(spark, "predictions")
    sinks.write_predictions(scored, path, "instant", "pred", fmt="parquet")
    return spark.read.parquet(path)


@query("S6_metric_table", f"""WITH {DEMAND} SELECT entity, count(*)::BIGINT AS n, round(avg(cnt), 6) AS mean_cnt
FROM demand GROUP BY entity""")
def metric_table(spark, d):
    """Metrics written as JSON with NaN refused, then read with their schema."""
    metrics = rounded(demand(spark, d).groupBy("entity").agg(F.count("*").alias("n"), F.avg("cnt").alias("mean_cnt")))
    path = shared_folder(spark, "metrics")
    sinks.write_metrics(metrics, path)
    return sinks.read_model_table(spark, path, T.StructType([
        T.StructField("entity", T.StringType()), T.StructField("n", T.LongType()), T.StructField("mean_cnt", T.DoubleType())]))


@query("S7_model_table", f"""WITH {DEMAND}, m AS (SELECT avg(temp) AS mean, stddev_pop(temp) AS std FROM demand)
SELECT instant, round((temp - mean) / std, 6) AS z FROM demand, m""")
def model_table(spark, d):
    """Fitted state stored, read back and applied."""
    df = demand(spark, d)
    path = shared_folder(spark, "scaler")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("mean", T.DoubleType()),
                           T.StructField("std", T.DoubleType())])
    sinks.write_metrics(df.agg(F.lit("temp").alias("name"), F.avg("temp").alias("mean"), F.stddev_pop("temp").alias("std")), path)
    row = sinks.read_model_table(spark, path, schema).where("name = 'temp'").first()
    return df.select("instant", r6((F.col("temp") - row["mean"]) / row["std"]).alias("z"))


# ----------------------------------------------------------------------------- calendar and encoding

_SQL_HR = ", ".join(f"CASE WHEN hr = {h} THEN 1.0::DOUBLE ELSE 0 END AS hr_{h}" for h in range(1, 24))
_SQL_WK = ", ".join(f"CASE WHEN weekday = {h} THEN 1.0::DOUBLE ELSE 0 END AS wk_{h}" for h in range(1, 7))


def _columns(name: str, sql: str, build):
    """Register a pure select over the demand table."""
    def run(spark, d):
        return demand(spark, d).select("instant", *[c.alias(n) for n, c in build().items()])
    run.__doc__ = name
    query(name, f"WITH {DEMAND} SELECT instant, {sql} FROM demand")(run)


_columns("P1_one_hot", _SQL_HR + ", " + _SQL_WK,
         lambda: {**cal.one_hot("hr", range(1, 24), "hr_"), **cal.one_hot("weekday", range(1, 7), "wk_")})
_columns("P2_category_merge", "least(weathersit, 3) AS ws, CASE WHEN least(weathersit, 3) = 2 THEN 1.0::DOUBLE ELSE 0 END AS ws_2, "
         "CASE WHEN least(weathersit, 3) = 3 THEN 1.0::DOUBLE ELSE 0 END AS ws_3",
         lambda: {"ws": cal.merge_top("weathersit", 3), **cal.one_hot(cal.merge_top("weathersit", 3), (2, 3), "ws_")})
_columns("P4_linear_trend", f"CAST(datediff('day', DATE '{EPOCH}', dteday) AS DOUBLE) AS trend",
         lambda: {"trend": cal.linear_trend("dteday", EPOCH)})
_columns("P5_year_harmonics", ", ".join(
    f"round({f}(2 * pi() * {k} * dayofyear(dteday) / 365.25), 6) + 0.0 AS doy_{f[0]}{k}" for k in (1, 2, 3) for f in ("sin", "cos")),
    lambda: {n: r6(c) for n, c in cal.year_harmonics("dteday", (1, 2, 3)).items()})
_columns("P6_hour_harmonics", ", ".join(
    f"round({f}(2 * pi() * {k} * hr / 24), 6) + 0.0 AS hour_{f[0]}{k}" for k in range(1, 7) for f in ("sin", "cos")),
    lambda: {n: r6(c) for n, c in cal.hour_harmonics("hr").items()})
_columns("P7_numeric_hour", "CAST(hr AS DOUBLE) AS hr_num", lambda: {"hr_num": F.col("hr").cast("double")})
_columns("P14_day_parts", "CASE WHEN hr < 6 THEN 'night' WHEN hr < 10 THEN 'am' WHEN hr < 16 THEN 'mid' WHEN hr < 20 THEN 'pm' "
         "ELSE 'eve' END AS part, CASE WHEN hr < 6 THEN 'night' WHEN hr < 7 THEN 'gap' WHEN hr < 10 THEN 'am' WHEN hr < 16 "
         "THEN 'mid' WHEN hr < 20 THEN 'pm' ELSE 'eve' END AS slope_part",
         lambda: {"part": cal.day_part("hr", cal.DAY_PARTS), "slope_part": cal.day_part("hr", cal.SLOPE_PARTS)})
_columns("P15_day_type", "CASE WHEN workingday = 1 THEN 'work' ELSE 'off' END AS day_type",
         lambda: {"day_type": cal.day_type("workingday")})
_columns("P16_trend_hinges", ", ".join(f"CAST(greatest(datediff('day', DATE '{EPOCH}', dteday) - {k}, 0) AS DOUBLE) AS hinge_{k}"
                                       for k in (7, 14, 21)), lambda: cal.hinges("dteday", EPOCH, (7, 14, 21)))
_columns("P17_root_trend", f"round(sqrt(datediff('day', DATE '{EPOCH}', dteday)), 6) AS root",
         lambda: {"root": r6(cal.root_trend("dteday", EPOCH))})
_columns("P34_fixed_width_bins", "CASE WHEN hum <= 0 OR hum > 1.0 THEN NULL ELSE CAST(" + " + ".join(
    f"CASE WHEN hum > {round(i * 0.1, 1)}::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10)) + " AS INTEGER) END AS bin",
    lambda: {"bin": cal.half_open_bin("hum", [round(i * 0.1, 1) for i in range(11)])})
_columns("P28_power_target", "round(ln(1 + cnt), 6) AS z_log, round(((cnt + 1.0::DOUBLE) ** 0.1::DOUBLE - 1) / 0.1::DOUBLE, 6) AS z_power",
         lambda: {"z_log": r6(tg.PowerTarget(0.0).forward("cnt")), "z_power": r6(tg.PowerTarget(0.1).forward("cnt"))})
_columns("P29_inverse_target", "round(exp(temp * 4), 6) AS q_log, round(greatest(0.1::DOUBLE * (temp * 4 - 11) + 1, 1e-9::DOUBLE) "
         "** 10.0::DOUBLE, 6) AS q_power, round((greatest(0.1::DOUBLE * (temp * 4) + 1, 1e-9::DOUBLE) ** 10.0::DOUBLE) ** 0.9::DOUBLE, 6) "
         "AS slope", lambda: {"q_log": r6(tg.PowerTarget(0.0).inverse(F.col("temp") * 4)),
                              "q_power": r6(tg.PowerTarget(0.1).inverse(F.col("temp") * 4 - 11)),
                              "slope": r6(tg.PowerTarget(0.1).slope(F.col("temp") * 4))})
_columns("P32_sigmoid", "round(1 / (1 + exp(-(temp * 8 - 2))), 6) AS p", lambda: {"p": r6(tg.sigmoid(F.col("temp") * 8 - 2))})
_columns("P33_linear_predictor", "round(0.5 + 2 * temp - 0.25 * hum + 0.125 * windspeed, 6) + 0.0 AS eta",
         lambda: {"eta": r6(tg.linear_score({"temp": 2.0, "hum": -0.25, "windspeed": 0.125}, 0.5))})


@query("P3_fault_imputation", f"""WITH {DEMAND}, fill AS (SELECT quantile_cont(hum, 0.5) AS f FROM demand
WHERE hum > 0 AND dteday < DATE '{CUT_DATE}') SELECT instant, round(CASE WHEN hum = 0 THEN f ELSE hum END, 6) AS hum FROM demand, fill""")
def fault_imputation(spark, d):
    """Median of the positive readings before the cut, applied to every row."""
    df = demand(spark, d)
    fill, = quantile_values(df.where((F.col("hum") > 0) & (F.col("dteday") < F.lit(CUT_DATE).cast("date"))), "hum", [0.5])
    return df.select("instant", r6(cal.impute_fault("hum", fill)).alias("hum"))


@query("P18_month_levels", """WITH m AS (SELECT o_orderkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS ym FROM orders)
SELECT o_orderkey, CAST(ym AS INTEGER) AS ym, """ + ", ".join(
    f"CASE WHEN ym = {k} THEN 1.0::DOUBLE ELSE 0 END AS ym{k}" for k in range(1, 80)) + " FROM m")
def month_levels(spark, d):
    """Indicators of the year-month, counted from the base year, up to the last month of the table."""
    orders = src.table(spark, d, "orders", ["o_orderkey", "o_orderdate"])
    yr, mn = F.year("o_orderdate") - 1995, F.month("o_orderdate")
    last = orders.agg(F.max(cal.month_number(yr, mn))).first()[0] or 0
    return orders.select("o_orderkey", cal.month_number(yr, mn).alias("ym"),
                         *[c.alias(n) for n, c in cal.month_levels(yr, mn, range(1, last + 1)).items()])


# ----------------------------------------------------------------------------- the timeline

_LAG = """LEFT JOIN k l{h} ON l{h}.user_id = a.user_id AND l{h}.hour_idx = a.hour_idx - ({h1})"""


def _lag_joins(hours):
    return " ".join(f"LEFT JOIN k l{i} ON l{i}.user_id = a.user_id AND l{i}.hour_idx = a.hour_idx - ({h})"
                    for i, h in enumerate(hours))


@query("P8_weather_memory", f"""WITH {DEMAND}, k AS (SELECT *, entity AS user_id, least(weathersit, 3) AS ws FROM demand)
SELECT a.instant, coalesce(l0.ws, a.ws) AS ws_lag1,
  greatest(coalesce(l0.ws, a.ws), coalesce(l1.ws, a.ws), coalesce(l2.ws, a.ws)) AS wet3 FROM k a {_lag_joins([1, 2, 3])}""")
def weather_memory(spark, d):
    """Situation one hour earlier and the worst of three hours."""
    return tl.weather_memory(demand(spark, d), keys=["entity"], unique=True).select("instant", "ws_lag1", "wet3")


@query("P9_memory_indicators", f"""WITH {DEMAND}, k AS (SELECT *, entity AS user_id, least(weathersit, 3) AS ws FROM demand),
m AS (SELECT a.instant, coalesce(l0.ws, a.ws) AS g,
  greatest(coalesce(l0.ws, a.ws), coalesce(l1.ws, a.ws), coalesce(l2.ws, a.ws)) AS w FROM k a {_lag_joins([1, 2, 3])})
SELECT instant, (g = 2)::DOUBLE AS wslag1_2, (g = 3)::DOUBLE AS wslag1_3, (w = 2)::DOUBLE AS wet3_2, (w = 3)::DOUBLE AS wet3_3 FROM m""")
def memory_indicators(spark, d):
    """0/1 columns of the memory."""
    m = tl.weather_memory(demand(spark, d), keys=["entity"], unique=True)
    return m.select("instant", *[c.alias(n) for n, c in {**cal.one_hot("ws_lag1", (2, 3), "wslag1_"),
                                                         **cal.one_hot("wet3", (2, 3), "wet3_")}.items()])


@query("P10_lag_by_timestamp", f"""WITH {TIMELINE}, k AS (SELECT * FROM timeline)
SELECT a.user_id, a.hour_idx, coalesce(l0.cents, a.cents) AS lag1, coalesce(l1.cents, a.cents) AS lag24,
a.cents - coalesce(l2.cents, a.cents) AS change3 FROM k a {_lag_joins([1, 24, 3])}""")
def lag_by_timestamp(spark, d):
    """A column some hours earlier, its own value when that hour is absent."""
    df = timeline(spark, d)
    out = tl.shifted(df, None, ["user_id"], {"lag1": ("cents", 1), "lag24": ("cents", 24), "lag3": ("cents", 3)})
    return out.select("user_id", "hour_idx", "lag1", "lag24", (F.col("cents") - F.col("lag3")).alias("change3"))


@query("P11_lead_by_timestamp", f"""WITH {TIMELINE}, k AS (SELECT *, least(weathersit, 3) AS ws FROM timeline)
SELECT a.user_id, a.hour_idx, coalesce(l0.ws, a.ws) AS lead1,
greatest(coalesce(l0.ws, a.ws), coalesce(l1.ws, a.ws), coalesce(l2.ws, a.ws)) AS next3 FROM k a {_lag_joins([-1, -2, -3])}""")
def lead_by_timestamp(spark, d):
    """Hours ahead; a diagnostic that must never feed a forecast."""
    df = timeline(spark, d).withColumn("ws", F.least("weathersit", F.lit(3)))
    leads = {f"lead{h}": ("ws", -h) for h in (1, 2, 3)}
    out = tl.shifted(df, df.select("user_id", "hour_idx", "ws"), ["user_id"], leads)
    return out.select("user_id", "hour_idx", "lead1", F.greatest("lead1", "lead2", "lead3").alias("next3"))


_SIX = ", ".join(f"coalesce(l{i}.rain, a.rain)" for i in range(6))
_THREE = ", ".join(f"coalesce(l{i}.dry, a.dry)" for i in range(3))


@query("P12_rolling_extremes", f"""WITH {TIMELINE}, k AS (SELECT *, CASE WHEN least(weathersit, 3) >= 2 THEN 1 ELSE 0 END AS rain,
CASE WHEN weathersit = 1 THEN 1 ELSE 0 END AS dry FROM timeline)
SELECT a.user_id, a.hour_idx, greatest({_SIX}) AS rain6, least({_THREE}) AS dry3 FROM k a {_lag_joins([1, 2, 3, 4, 5, 6])}""")
def rolling_extremes(spark, d):
    """Rain in the last six hours, dry for three."""
    df = timeline(spark, d)
    wet = tl.rolling_extremes(df, ["user_id"], (F.col("weathersit") >= 2).cast("int"), 6, True, "rain6")
    both = tl.rolling_extremes(wet, ["user_id"], (F.col("weathersit") == 1).cast("int"), 3, False, "dry3")
    return both.select("user_id", "hour_idx", "rain6", "dry3")


@query("P13_day_context", f"""WITH {DEMAND}, g AS (SELECT entity, dteday, avg(temp) AS t, avg(hum) AS h,
avg(CASE WHEN least(weathersit, 3) >= 2 THEN 1.0 ELSE 0 END) AS w, avg(CASE WHEN weathersit >= 3 THEN 1.0 ELSE 0 END) AS r
FROM demand GROUP BY ALL) SELECT instant, round(t, 6) AS day_temp, round(h, 6) AS day_hum, round(w, 6) AS day_wet, round(r, 6) AS day_rain
FROM demand JOIN g USING (entity, dteday)""")
def day_context(spark, d):
    """Same-day means and wet shares on every row."""
    ws = F.least("weathersit", F.lit(3))
    out = tl.day_context(demand(spark, d), ["entity"], {
        "day_temp": F.avg("temp"), "day_hum": F.avg("hum"), "day_wet": F.avg((ws >= 2).cast("double")),
        "day_rain": F.avg((ws >= 3).cast("double"))})
    return rounded(out.select("instant", "day_temp", "day_hum", "day_wet", "day_rain"))


# ----------------------------------------------------------------------------- label side

@query("P30_prediction_cap", f"""WITH {DEMAND}, c AS (SELECT ((exp(1.0::DOUBLE) * (max(cnt) + 1)) ** 0.1::DOUBLE - 1) / 0.1::DOUBLE AS cap
FROM demand WHERE dteday < DATE '{CUT_DATE}') SELECT instant, round(least(temp * 12, cap), 6) AS eta FROM demand, c""")
def prediction_cap(spark, d):
    """Linear scores held at the cap learned from the fitting rows."""
    df = demand(spark, d)
    t = tg.PowerTarget(0.1)
    top = df.where(F.col("dteday") < F.lit(CUT_DATE).cast("date")).agg(F.max("cnt")).first()[0]
    return df.select("instant", r6(t.capped(F.col("temp") * 12, t.cap(float(top)))).alias("eta"))


@query("P31_clip_at_zero", f"""WITH {DEMAND}, u AS (SELECT entity, 0.9::DOUBLE * exp(temp * 4 - 1) - 1 AS x FROM demand)
SELECT entity, count(*) FILTER (x < 0)::BIGINT AS n_clipped, round(sum(greatest(x, 0)), 6) AS total FROM u GROUP BY entity""")
def clip_at_zero(spark, d):
    """Counts held at zero, with the number that were below it."""
    t = tg.PowerTarget(0.0)
    eta = F.col("temp") * 4 - 1
    return rounded(demand(spark, d).groupBy("entity").agg(
        F.sum((t.unclipped(eta, 0.9) < 0).cast("bigint")).alias("n_clipped"), F.sum(t.counts(eta, 0.9)).alias("total")))


@query("P35_value_bands", f"""WITH {DEMAND}, q AS (SELECT quantile_cont(cnt, 0.95) AS top FROM demand)
SELECT CASE WHEN cnt <= 1 THEN 'low' WHEN cnt >= top THEN 'top' ELSE 'middle' END AS band, count(*)::BIGINT AS n, sum(cnt)::BIGINT AS total
FROM demand, q GROUP BY 1""")
def value_bands(spark, d):
    """Low, middle and top bands cut at a quantile."""
    df = demand(spark, d)
    top, = quantile_values(df, "cnt", [0.95])
    band = F.when(F.col("cnt") <= 1, "low").when(F.col("cnt") >= top, "top").otherwise("middle")
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("cnt").alias("total"))
