"""The text operators and the pipeline are parts: the rest works without them."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(k.startswith('op') and '_' in k and k[2].isdigit() for k in q), 'pipeline' in q)"


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_without_text_operators(tmp_path, pipeline_too):
    """Whether or not the pipeline's file goes with the folders."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", *(["corpus_pipeline.py"] if pipeline_too else []))
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    got = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True)
    n, ops, pipeline = got.stdout.split()
    assert int(n) > 80 and ops == "0" and pipeline == "False"


def test_nothing_else_imports_them():
    for f in (ROOT / "quillspan").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
