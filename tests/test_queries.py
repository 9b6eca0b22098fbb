import pytest
from conftest import same
from weftgraph.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        same(df, SQL[name], sf_dir)
    else:
        assert df.count() > 0
