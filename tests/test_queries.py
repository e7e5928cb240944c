"""Every registered query of the catalog engine against its SQL, and the rest against plain Python."""

import difflib

import pytest

from quarrystone.plans import registry
from tests.compare import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_name_similarity(spark):
    for r in registry.queries()["entity_name_similarity"](spark, SF).collect():
        assert r["ratio"] == pytest.approx(difflib.SequenceMatcher(None, r["n_name"].lower(), r["r_name"].lower()).ratio(), abs=1e-6)


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
