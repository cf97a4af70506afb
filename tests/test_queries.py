"""Every registered query against its SQL."""

import pytest
from conftest import DATA, check_query

from quillspark.plans import registry


def test_all_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    check_query(spark, registry.QUERIES[name], registry.ORACLE[name], f"{DATA}/sf0.01")
