"""The registered queries that SQL can express, against their SQL."""

import pytest
from conftest import DATA, check_query

from quillspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    check_query(spark, queries.QUERIES[name], queries.ORACLE[name], f"{DATA}/sf0.01")
