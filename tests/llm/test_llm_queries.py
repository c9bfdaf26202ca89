import pytest
from sql_compare import connect, rows

from stratalore.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert rows(llm.queries()[name](spark, sf).toPandas()) == rows(connect(sf).execute(llm.oracle_sql()[name]).df())


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
