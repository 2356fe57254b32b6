"""The driver contract, also without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
from tests.conftest import HOME


def test_names(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10


def test_imports_without_the_subpackage(tmp_path):
    shutil.copytree(f"{HOME}/spendlight", tmp_path / "spendlight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{HOME}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, check=True)
