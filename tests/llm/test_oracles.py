import pytest

from matchloom.llm import registry

from ..oracle import compare
from .conftest import SF


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, name):
    compare(registry.QUERIES[name](spark, SF), registry.ORACLES[name], SF)
