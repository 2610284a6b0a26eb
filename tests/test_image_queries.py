import pytest
from conftest import same_rows

from framemill.plans.oracles import ORACLES
from framemill.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf_dir, duck):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert [r["n"] for r in sorted(rows)] == [7680] * 4
