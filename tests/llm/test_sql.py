import pytest
from compare import connect, difference

from pagetrove.llm.queries import LLM_ORACLES, LLM_QUERIES


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_equals_sql(spark, sf_dir, name):
    assert difference(LLM_QUERIES[name](spark, sf_dir), connect(sf_dir), LLM_ORACLES[name]) is None
