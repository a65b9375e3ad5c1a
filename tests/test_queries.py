import pytest

from itemforge.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert not differences(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_assembled_quizzes_keep_to_their_budgets(spark):
    quizzes = registry.QUERIES["quiz_assembly"](spark, SF).groupBy("request_id").count().collect()
    # a group of three may exceed a budget that nothing fits
    assert quizzes and all(r["count"] <= max(3, r.request_id % 12) for r in quizzes)
