import pytest
from oracle import connect, same

from fitloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], duck)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_topn_is_cut_before_the_shuffle(spark):
    plan = catalogue.queries()["q_topn_stable"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_formula_stays_in_generated_code(spark):
    plan = catalogue.queries()["q_formula_eval"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<l_orderkey" in plan
