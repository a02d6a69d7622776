"""The rest of the library without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_queries_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    said = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'rul_all' in q and set(s) <= set(q) and 'pipeline' not in q; print('ok')"
    assert subprocess.run([sys.executable, "-c", said], cwd=copy, capture_output=True, text=True, timeout=120).stdout == "ok\n"
