"""The rest of the library without the training-data subpackage, its tests and its pipeline."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_and_tests_without_the_subpackage(tmp_path, pipeline):
    """``pipeline``: whether corpus_pipeline.py is left where the subpackage is gone."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", *(() if pipeline else ("corpus_pipeline.py",))))
    assert not (copy / "loomtext/llm").exists() and not (copy / "tests/llm").exists()
    ask = "import __spark_entry__ as e; q = set(e.queries()); assert q and set(e.oracle_sql()) <= q; assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", ask], cwd=copy, check=True, env=env)
    found = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, env=env)
    assert found.returncode == 0, found.stdout + found.stderr
    assert "test_query_equals_sql[split_words]" in found.stdout


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "loomtext").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "loomtext").parts:
            assert "loomtext.llm" not in path.read_text(), path
