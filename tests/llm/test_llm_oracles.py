import pytest
from compare import SF, connection, differences
from scenequarry.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    assert not differences(QUERIES[name](spark, SF), connection().sql(ORACLE_SQL[name]))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
