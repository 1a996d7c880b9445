import pytest

import __spark_entry__ as entry
from brookmill.plans import registry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(spark, con, name):
    made = registry.QUERIES[name](spark, SF).toPandas()
    wanted = con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert oracle.rows_of(made) == oracle.rows_of(wanted)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_library_is_registered():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_and_columns_reach_the_scan(spark):
    plan = registry.QUERIES["uncorrected_drafts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan
