import pytest

from cellarium.llm import registry
from tests.oracle import connection, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.count() > 0 and {"doc_id", "page_id"} & set(df.columns)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    same(registry.QUERIES[name](spark, SF), connection(SF), registry.ORACLE[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
