import pytest
from compare import SF, connection, differences
from scenequarry.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert not differences(df, con.sql(ORACLE_SQL[name]))
    else:
        assert df.count()


def test_entry_without_the_llm_folder(monkeypatch, spark):
    import importlib
    import sys

    for name in [m for m in sys.modules if m.startswith("scenequarry.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "scenequarry.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLE_SQL)
    sys.modules.pop("__spark_entry__")
