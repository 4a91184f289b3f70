"""The registry without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"


@pytest.mark.parametrize("gone", [("threadwise/llm",), ("threadwise/llm", "corpus_pipeline.py")])
def test_other_queries_load_alone(tmp_path, gone):
    skipped = [tmp_path / "copy" / name for name in gone]

    def left_out(folder, names):
        at = tmp_path / "copy" / Path(folder).relative_to(ROOT)
        return [n for n in names if at / n in skipped or n.startswith(".") or n == "__pycache__"]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    done = subprocess.run(
        [sys.executable, "-c", COUNT], cwd=tmp_path / "copy", capture_output=True, text=True
    )
    assert done.returncode == 0, done.stderr
    found, checked = map(int, done.stdout.split())
    assert found >= 132 and checked >= 130
