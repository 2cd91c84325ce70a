import pytest
from compare import rows, sql_rows
from compare import SF

from graphloom import catalog
from graphloom.catalog_operations import OPERATIONS
from graphloom.plans.planner import run
from graphloom.sources.tables import graph_from_tables


@pytest.fixture(scope="module")
def graph(spark):
    return graph_from_tables(spark, SF).cached()


@pytest.mark.parametrize("key", catalog.CYPHER)
def test_query_gives_the_rows_of_its_sql(graph, duck, key):
    text, sql, *params = catalog.CYPHER[key]
    assert rows(run(graph, text, *params)) == sql_rows(duck, sql)


@pytest.mark.parametrize("key", OPERATIONS)
def test_operation_gives_the_rows_of_its_sql(spark, duck, key):
    call, sql = OPERATIONS[key]
    got = rows(call(spark, SF))
    if sql:
        assert got == sql_rows(duck, sql)
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
