"""Every query that SQL can express against DuckDB; the others run and have rows."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

from sumbrook import queries

from .oracle import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    check(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_has_rows(spark, sf_dir, name):
    assert not queries.QUERIES[name](spark, sf_dir).isEmpty()


def test_entry_works_without_the_removable_folder():
    code = "import sys; sys.modules['sumbrook.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=True)


def test_the_library_never_imports_the_removable_folder():
    root = Path(__file__).parent.parent / "sumbrook"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and re.search(r"\bllm\b", p.read_text())]
