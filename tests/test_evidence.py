"""Evidence, verdicts and selection on events where a column has one value only, or where no column is useful."""
import duckdb
import pytest
from compare import differences

from hourwise.operators import selection
from hourwise.queries import registry, validation


def events(folder, value: str) -> str:
    """Events of 30 days, 24 hours and two types, 4 to 8 in each, as `folder`/events.parquet; `value` of event i, the j-th of its hour."""
    duckdb.sql(f"""COPY (SELECT row_number() OVER () AS event_id, ts, i % 97 AS user_id, kind AS event_type, CAST({value} AS DOUBLE) AS value, '' AS props
      FROM (SELECT h, kind, TIMESTAMP '2024-01-01' + to_hours(h::INT) + to_minutes(j::INT) AS ts, j, hash(h * 10 + j + length(kind) * 100000) AS i
      FROM range(720) a(h), (VALUES ('a'), ('bb')) b(kind), range(8) c(j) WHERE j < 4 + hash(h * 3 + length(kind)) % 5) ) TO '{folder}/events.parquet'""")
    return str(folder)


def same_as_sql(spark, folder, name) -> str:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return differences(registry.QUERIES[name](spark, folder), con.sql(registry.SQL[name]))


VALUES = {"weathersit": "CASE WHEN j < 3 THEN 101 + i % 300 ELSE i % 100 END",     # always three above 100: weathersit is 4 everywhere
          "temp and atemp": "12.34", "no values": "NULL"}


@pytest.mark.parametrize("constant", VALUES)
def test_evidence_text_with_a_constant_column(spark, tmp_path, constant):
    assert same_as_sql(spark, events(tmp_path, VALUES[constant]), "V10_evidence_text") == ""


@pytest.mark.parametrize("constant", VALUES)
def test_column_verdicts_with_a_constant_column(spark, tmp_path, constant):
    assert same_as_sql(spark, events(tmp_path, VALUES[constant]), "V7_column_verdicts") == ""


def test_sentence_with_missing_numbers(spark):
    rows = [("a", None, None, None, None, None, None, "b", ""), ("b", 0.5, 0.4, 0.6, None, None, None, None, ""),
            ("c", 0.5, 0.4, 0.6, 0.1, 0.2, float("nan"), "a", "b"), ("d", 0.5, 0.4, 0.6, None, 0.2, None, "a", "")]
    table = spark.createDataFrame(rows, "column string, delta double, lo double, hi double, group_delta double, solo_r2 double, max_abs_corr double, corr_with string, carried_by string")
    got = {r["column"]: r["evidence"] for r in selection.evidence_text(table).collect()}
    begin = "without it R2 changes by -0.5000 (-0.6000 to -0.4000)"
    assert got == {"a": None, "b": begin + ".", "d": None,
                   "c": begin + "; without its whole group by -0.1000; by itself it explains 0.2000; closest column a at |r| nan; replaceable by b."}


def test_selection_without_a_useful_column(spark, tmp_path, monkeypatch):
    found = {"delta": 0.0, "lo": -0.1, "hi": 0.1, "day_delta": 0.0, "solo_r2": 0.001, "max_abs_corr": 0.2, "vif_max": 1.0}
    monkeypatch.setattr(validation.search, "column_evidence", lambda *_: [{"column": c, "corr_with": "hr", **found} for c in ("temp", "hum")])
    got = registry.QUERIES["V8_column_selection"](spark, events(tmp_path, VALUES["weathersit"]))
    assert got.dtypes == [("feature", "string"), ("weight", "double"), ("freq", "double")]
    assert got.collect() == []
