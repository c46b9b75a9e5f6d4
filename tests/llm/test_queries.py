import pytest

from conftest import same
from evidentia.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, sf, duck):
    df = Q.QUERIES[name](spark, sf)
    if name in Q.ORACLES:
        same(df, duck, Q.ORACLES[name])
    else:
        assert df.distinct().count() == df.count()
