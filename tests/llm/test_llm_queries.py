import subprocess
import sys
from pathlib import Path

import pytest
from conftest import ROOT, TESTDATA, same_as_sql

from triloom.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_agrees_with_sql(spark, duck, name):
    same_as_sql(spark, duck, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_other_queries_run(spark, duck, name):
    assert queries.QUERIES[name](spark, str(TESTDATA)).count() > 0


def test_found_queries_have_the_columns_asked_for(spark, duck):
    want = {"p2_found": [("token_a", "int"), ("token_b", "int")], "p3_found": [("edge_id", "bigint")], "p4_found": [("token", "int"), ("mark", "string")], "p6_found": [("first_row_id", "bigint"), ("copy_row_id", "bigint")], "p9_found": [("doc_id", "bigint"), ("area", "string")]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, str(TESTDATA)).dtypes == columns


def test_nothing_else_imports_the_subpackage():
    others = [p for p in (Path(ROOT) / "triloom").rglob("*.py") if "llm" not in p.relative_to(Path(ROOT) / "triloom").parts]
    assert not [p for p in others if "triloom.llm" in p.read_text()]
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
