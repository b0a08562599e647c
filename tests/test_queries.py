"""Every registered query of the library against its SQL; those without SQL run and give rows."""

import pytest
from oracle import expected, same

from meridia.plans import registry

registry.load()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.ORACLES:
        want = expected(registry.ORACLES[name], sf)
        assert sorted(got.columns) == sorted(want.columns)
        same(got, want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
