"""Every query of the engine beside its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import duck, rows  # noqa: E402

from evidentia.plans import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(duck(sf).sql(registry.ORACLES[name]).df())
    else:
        assert len(got)


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
