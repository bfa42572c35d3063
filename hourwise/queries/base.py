"""Registry of queries and the demand tables they share.

`demand` is the hourly table of each event type; `timeline` is the hourly table of each user, which has gaps; `daily` is
the order book per day. Each has a Spark form and an SQL form that read the same parquet files."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourwise.functions import calendar as cal
from hourwise.operators.ranks import hash32
from hourwise.session import Lease, leased
from hourwise.sources.tables import hourly_rollup, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Settings of the example demand table.
BASE_YEAR = 2024
EPOCH = "2024-01-01"
HOLIDAYS = ("2024-01-01", "2024-01-15")
CUT_DATE = "2024-01-21"
SEED = 44615
FOLDS = 5


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can state it, the SQL that must give the same rows."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double; adding zero turns a negative zero into zero."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, every integer count left alone."""
    return df.select(*[r6(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def settled(df: DataFrame) -> DataFrame:
    """A summary of a few rows evaluated now, while the frames behind it are kept."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _measures() -> dict[str, Column]:
    cents = F.round(F.col("value") * 100).cast("bigint")
    n = F.count("*")

    def share(cond: Column) -> Column:
        return F.sum(cond.cast("bigint")) / n.cast("double")
    return {"cnt": n, "temp": F.sum(cents) / n.cast("double") / 19997.0, "atemp": F.max(cents) / 49999.0,
            "hum": share(cents > 5000), "windspeed": share(cents < 1000),
            "weathersit": F.least(1 + F.sum((cents > 10000).cast("bigint")), F.lit(4)).cast("int")}


_KEPT: dict[tuple[str, str], Lease] = {}


def demand(spark: SparkSession, folder: str) -> DataFrame:
    """The hourly demand table, rolled up from the events once per session and folder and leased (memory, then disk).

    Most queries read it two or three times; without this each reading would scan the raw events again. `release_all` ends
    the lease, and the next reader takes a new one."""
    at = (spark.sparkContext.applicationId, folder)
    if at not in _KEPT or not _KEPT[at].held:
        _KEPT[at] = leased(rolled_demand(spark, folder))
    return _KEPT[at].frame


def rolled_demand(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly demand per event type with the calendar, the weather-like readings and the label."""
    events = table(spark, folder, "events", ["event_type", "ts", "value"])
    rolled = hourly_rollup(events, ["event_type"], _measures()).withColumnRenamed("event_type", "entity")
    # one row per event type: its number in alphabetical order, and room for all of them behind the hour
    order = Window.orderBy(F.col("event_type").asc_nulls_first())
    room = F.pow(F.lit(10), F.length(F.count("*").over(Window.partitionBy()).cast("string"))).cast("bigint")
    kinds = events.select("event_type").distinct().select(F.col("event_type").alias("_kind"), F.row_number().over(order).alias("_code"), room.alias("_room"))
    numbered = rolled.join(kinds, F.col("entity").eqNullSafe(F.col("_kind")))
    return (numbered.withColumns(cal.calendar_columns("dteday", BASE_YEAR, HOLIDAYS))
            .withColumn("instant", (F.col("hour_idx") * F.col("_room") + F.col("_code")).cast("bigint")).drop("_kind", "_code", "_room"))


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """`demand` with the seeded side, the day fold and the chronological side of every row."""
    df = demand(spark, folder)
    return df.withColumns({"val": (hash32(SEED, "instant") < int(0.2 * 2 ** 32)).cast("int"),
                           "late": (F.col("dteday") >= F.lit(CUT_DATE).cast("date")).cast("int")})


def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly rows of each user: many hours are absent."""
    events = table(spark, folder, "events", ["user_id", "event_type", "ts", "value"])
    return hourly_rollup(events, ["user_id"], {
        "cnt": F.count("*"), "cents": F.sum(F.round(F.col("value") * 100).cast("bigint")),
        "weathersit": F.least(1 + F.sum((F.col("event_type") == "error").cast("bigint")), F.lit(4)).cast("int")})


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per day."""
    orders = table(spark, folder, "orders", ["o_orderdate", "o_totalprice"])
    return (orders.groupBy(F.to_date("o_orderdate").alias("d"))
            .agg(F.count("*").alias("cnt"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
            .withColumns({"yr": F.year("d"), "mnth": F.month("d"), "dom": F.dayofmonth("d")}))


_HOLIDAY_LIST = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)
DEMAND = f"""ev AS (SELECT event_type, user_id, CAST(ts AS DATE) AS dteday, CAST(hour(ts) AS INTEGER) AS hr,
  CAST(round(value * 100) AS BIGINT) AS cents FROM events),
kinds AS (SELECT event_type AS entity, row_number() OVER (ORDER BY event_type) AS code,
  CAST(10 ** length(CAST(count(*) OVER () AS VARCHAR)) AS BIGINT) AS room FROM (SELECT DISTINCT event_type FROM events)),
rolled AS (SELECT event_type AS entity, dteday, hr, CAST(count(*) AS BIGINT) AS cnt,
  CAST(sum(cents) AS DOUBLE) / count(*) / 19997.0::DOUBLE AS temp, CAST(max(cents) AS DOUBLE) / 49999.0::DOUBLE AS atemp,
  CAST(count(*) FILTER (cents > 5000) AS DOUBLE) / count(*) AS hum,
  CAST(count(*) FILTER (cents < 1000) AS DOUBLE) / count(*) AS windspeed,
  CAST(least(1 + count(*) FILTER (cents > 10000), 4) AS INTEGER) AS weathersit,
  CAST(datediff('day', DATE '1970-01-01', dteday) * 24 + hr AS BIGINT) AS hour_idx
  FROM ev GROUP BY event_type, dteday, hr),
demand AS (SELECT * EXCLUDE (code, room), CAST(floor((month(dteday) - 1) / 3.0) + 1 AS INTEGER) AS season,
  CAST(year(dteday) - {BASE_YEAR} AS INTEGER) AS yr, CAST(month(dteday) AS INTEGER) AS mnth,
  CAST(CASE WHEN dteday IN ({_HOLIDAY_LIST}) THEN 1 ELSE 0 END AS INTEGER) AS holiday,
  CAST(dayofweek(dteday) AS INTEGER) AS weekday,
  CAST(CASE WHEN dayofweek(dteday) BETWEEN 1 AND 5 AND dteday NOT IN ({_HOLIDAY_LIST}) THEN 1 ELSE 0 END AS INTEGER) AS workingday,
  CAST(hour_idx * room + code AS BIGINT) AS instant FROM rolled JOIN kinds USING (entity))"""


def hash_sql(seed: int | str, *exprs: str) -> str:
    text = " || '_' || ".join([f"'{seed}'", *[f"CAST({e} AS VARCHAR)" for e in exprs]])
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


LABELLED = DEMAND + f""",
labelled AS (SELECT *, CASE WHEN {hash_sql(SEED, 'instant')} < {int(0.2 * 2 ** 32)} THEN 1 ELSE 0 END AS val,
  CASE WHEN dteday >= DATE '{CUT_DATE}' THEN 1 ELSE 0 END AS late FROM demand)"""
TIMELINE = """timeline AS (SELECT user_id, CAST(ts AS DATE) AS dteday, CAST(hour(ts) AS INTEGER) AS hr,
  CAST(count(*) AS BIGINT) AS cnt, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(least(1 + count(*) FILTER (event_type = 'error'), 4) AS INTEGER) AS weathersit,
  CAST(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 24 + hour(ts) AS BIGINT) AS hour_idx
  FROM events GROUP BY user_id, CAST(ts AS DATE), hour(ts))"""
DAILY = """daily AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(count(*) AS BIGINT) AS cnt,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(year(o_orderdate) AS INTEGER) AS yr,
  CAST(month(o_orderdate) AS INTEGER) AS mnth, CAST(dayofmonth(o_orderdate) AS INTEGER) AS dom
  FROM orders GROUP BY ALL)"""
