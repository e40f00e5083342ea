"""The driver's entry imports without a Spark session, and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(set(e.oracle_sql()) - set(e.queries())))"


def counted(folder) -> list[int]:
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, check=True)
    return [int(x) for x in done.stdout.split()[-2:]]


def test_entry_imports_with_and_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "corpusgap", tmp_path / "corpusgap", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    rest, unknown = counted(tmp_path)
    assert rest > 130 and unknown == 0
    whole, unknown = counted(ROOT)
    assert whole >= rest and unknown == 0
