import pytest
from conftest import same_rows

llm = pytest.importorskip("framemill.llm")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_against_sql(name, spark, sf_dir, duck):
    same_rows(llm.QUERIES[name](spark, sf_dir), duck.sql(llm.ORACLES[name]))
