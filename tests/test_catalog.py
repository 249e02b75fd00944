import oracle
import pytest

from engramlake.plans.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    if name in ORACLES:
        assert oracle.differences(df, ORACLES[name], "/root/testdata/sf0.001") is None
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
