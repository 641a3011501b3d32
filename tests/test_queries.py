import pytest
from compare import connect, difference

import __spark_entry__ as entry_module
from pagetrove.plans.oracles import ORACLES
from pagetrove.plans.queries import QUERIES


@pytest.fixture(scope="module")
def tables(sf_dir):
    return connect(sf_dir)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf_dir, tables, name):
    assert difference(QUERIES[name](spark, sf_dir), tables, ORACLES[name]) is None


def test_entry(spark):
    assert 0 < entry_module.entry(spark).count() <= 20


def test_entry_registers_all():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())
