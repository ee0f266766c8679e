"""The entry lists its queries with and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(set(e.oracle_sql()) - set(q)), sum(k.startswith('op') for k in q))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_training_operators(tmp_path, pipeline):
    skipped = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=skipped)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    queries, strays, numbered = map(int, run.stdout.split())
    assert queries > 200 and strays == 0 and numbered == 0
