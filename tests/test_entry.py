"""The entry points, and that they work without the optional text operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e
from tessera import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert e.entry(spark).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog.QUERIES) <= set(e.queries())


def test_without_text_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'voxel_grid' in q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "tessera").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tessera.llm" not in p.read_text()
