import os

import oracle
import pytest

from curatrix.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_as_its_sql(spark, con, name):
    oracle.agree(spark, con, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    registry.queries()[name](spark, oracle.DATA).collect()
