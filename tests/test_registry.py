"""The registry with and without the llm subpackage and the corpus pipeline."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [("plumbline/llm", "tests/llm"), ("plumbline/llm", "tests/llm", "corpus_pipeline.py")])
def test_registry_without_llm(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for name in gone:
        at = copy / name
        if at.is_dir():
            shutil.rmtree(at)
        else:
            at.unlink(missing_ok=True)
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    total, own = map(int, out.stdout.split())
    assert total > 70 and own == 0
