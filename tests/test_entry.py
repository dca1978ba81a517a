import importlib.util
import os
from pathlib import Path

import pytest

from verification import queries as registry

ENTRY = Path(__file__).resolve().parents[1] / "__spark_entry__.py"
pytestmark = pytest.mark.skipif(
    not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present"
)


@pytest.fixture(scope="module")
def module():
    spec = importlib.util.spec_from_file_location("spark_entry", ENTRY)
    loaded = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(loaded)
    return loaded


def test_flagship_query(spark, module):
    report = module.entry(spark)
    assert report.columns == [
        "category",
        "region",
        "order_count",
        "total_revenue",
        "avg_order_value",
        "total_stock",
        "refund_count",
        "total_refunds",
    ]
    assert report.count() > 0


def test_registry(module):
    assert set(registry.queries()) <= set(module.queries())
    assert set(module.oracle_sql()) <= set(module.queries())
    assert all(callable(query) for query in module.queries().values())
    assert all(isinstance(sql, str) for sql in module.oracle_sql().values())
