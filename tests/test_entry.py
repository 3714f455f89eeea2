"""The entry file where the optional subpackage is not installed."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FILES = ("cityflow", "__spark_entry__.py", "oracles.py")


@pytest.mark.parametrize("pipeline", [True, False])
def test_imports_without_the_optional_subpackage(tmp_path, pipeline):
    for name in (*FILES, *["corpus_pipeline.py"] * pipeline):
        there = os.path.join(ROOT, name)
        if os.path.isdir(there):
            shutil.copytree(there, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(there):
            shutil.copy(there, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr
    n, registered, covered = run.stdout.split()
    assert int(n) > 50 and (registered, covered) == ("False", "True")
