"""The registry works with and without the folder of text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names_in(folder: str) -> set[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return set(subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split())


@pytest.mark.parametrize("leave_caches", [False, True])
def test_without_the_folder(tmp_path, leave_caches):
    copy = str(tmp_path / "copy")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".hypothesis", ".pytest_cache"))
    if leave_caches:
        os.makedirs(f"{copy}/cairn/llm/__pycache__")
    names = names_in(copy)
    assert "list_files" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
