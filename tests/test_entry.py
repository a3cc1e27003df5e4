"""The entry points, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_queries_and_sql_fit():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "win1_agg1_signature_groups" in e.queries()


def test_entry_works_without_the_optional_parts():
    code = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("facetmill.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert "pipeline" not in e.queries() and not any(k.startswith("op") for k in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_flagship_query(spark):
    from facetmill import queries

    path = Path("/root/testdata/sf0.001")
    if path.exists():
        rows = queries.queries()["win1_agg1_signature_groups"](spark, str(path)).collect()
        assert rows and {r.group_id for r in rows} == {f"G{i + 1}" for i in range(len(rows))}
