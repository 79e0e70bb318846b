"""The driver contract with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LEFT_OUT = {"fieldspark/llm", "tests/llm", ".git"}


def names(at: Path) -> list[str]:
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=at, env=env, check=True, capture_output=True, text=True).stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_folders(tmp_path, pipeline):
    def left_out(folder, entries):
        here = Path(folder).relative_to(REPO)
        return [x for x in entries if str(here / x) in LEFT_OUT or x == "__pycache__" or (x == "corpus_pipeline.py" and not pipeline)]

    shutil.copytree(REPO, tmp_path / "copy", ignore=left_out)
    (tmp_path / "copy/fieldspark/llm/__pycache__").mkdir(parents=True)  # what a deletion of modules may leave
    found = names(tmp_path / "copy")
    assert "group_quality" in found and "pipeline" not in found and not any(x.startswith("op") for x in found)


def test_entry_as_it_is():
    whole = (REPO / "fieldspark/llm/queries.py").exists() and (REPO / "corpus_pipeline.py").exists()
    found = names(REPO)
    assert "group_quality" in found and ("pipeline" in found) == whole
