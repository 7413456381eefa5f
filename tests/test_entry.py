import pytest

import __spark_entry__ as entry
from tests.conftest import SF


def test_entry(spark):
    assert entry.entry(spark).count() == 720


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.registry.QUERIES if n not in entry.registry.ORACLE))
def test_queries_without_sql_run(spark, name):
    assert entry.queries()[name](spark, SF).limit(1).count() <= 1
