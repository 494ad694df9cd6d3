"""Every registered query against its SQL, over whole tables."""

import pytest
from compare import rows

from tidewire.plans import catalog

ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf, oracle):
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(oracle(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(ORACLES) - {"dedup_leader", "cluster_stories"}))
def test_other_queries_run(name, spark, sf):
    out = catalog.queries()[name](spark, sf).toPandas()
    assert len(out) > 0 and len(set(out.columns)) == len(out.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry.queries())
