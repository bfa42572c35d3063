"""Every registered query at the smallest scale: same rows as its SQL, or a non-empty result."""
import pytest

import __spark_entry__ as entry
from compare import differences, oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()
SLOW = {"E5_complexity_ladder_plan", "E33_penalty_rescue", "E25_label_foils", "E26_l2_sweep", "M12_boosted_trees_plan", "E4_fitter_protocol_trees"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    message = differences(QUERIES[name](spark, sf), con.sql(SQL[name])).replace("EMPTY", "").strip()
    assert message == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 4
