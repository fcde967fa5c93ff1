import pytest

from factloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(name, same):
    assert same(registry.QUERIES[name], registry.ORACLE_SQL[name]) > 0
