"""Every registered query beside its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from verification.compare import connect, differences  # noqa: E402
from verification.oracles import oracle_sql  # noqa: E402
from verification.queries import queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    assert differences(queries()[name](spark, SMALL), connection, oracle_sql()[name]) == []
