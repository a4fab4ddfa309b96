"""The entry module without the optional folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_import_without_text_operators(tmp_path, with_pipeline):
    shutil.copytree(REPO / "tidyledger", tmp_path / "tidyledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if with_pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    code = (
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'by_category' in names and 'pipeline' not in names\n"
        "assert not any(x.startswith('op') and x[2:3].isdigit() for x in names)\n"
        "assert set(e.oracle_sql()) <= set(names)"
    )
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_another_copy_on_the_path_does_not_count(tmp_path):
    shutil.copytree(REPO / "tidyledger", tmp_path / "tidyledger", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'by_category' in e.queries() and 'pipeline' not in e.queries()"
    env = {**os.environ, "PYTHONPATH": str(REPO)}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
