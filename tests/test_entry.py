import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and all(callable(q) for q in queries.values()) and len(queries) > 100


def test_without_llm():
    """The rest stands where the subpackage is gone."""
    code = "import sys; sys.modules['pitchgrid.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p9_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


def test_nothing_else_imports_llm():
    for p in (ROOT / "pitchgrid").rglob("*.py"):
        if "llm" not in p.parts:
            assert "pitchgrid.llm" not in p.read_text(), p


def test_flagship(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the given tables are not here")
    assert entry.entry(spark).count() > 0


def test_bench_names():
    out = subprocess.run([sys.executable, "-c", "import bench, __spark_entry__ as e, json; print(json.dumps([n for n in bench.HEADLINE if n not in e.queries()]))"], capture_output=True, text=True, cwd=ROOT, check=True, env=os.environ)
    assert all(n.startswith("p") for n in json.loads(out.stdout.splitlines()[-1]))
