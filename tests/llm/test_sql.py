"""The operators that SQL can express against DuckDB."""

import pytest

from sumbrook.llm import queries

from ..oracle import check, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    check(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])
