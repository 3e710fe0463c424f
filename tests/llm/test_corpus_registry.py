import pytest
from test_registry import pytestmark, same  # noqa: F401

from semlattice.llm import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    assert same(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
