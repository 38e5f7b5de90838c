"""The entry imports, and registers the library's queries, without the training-data folders."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _copy(to: str, *without: str) -> None:
    os.makedirs(to)
    for name in ("__spark_entry__.py", "oracle.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if name not in without and os.path.exists(source):
            shutil.copy(source, to)
    skipped = shutil.ignore_patterns("__pycache__", *without)
    shutil.copytree(os.path.join(ROOT, "textprep"), os.path.join(to, "textprep"), ignore=skipped)


@pytest.mark.parametrize("without", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_training_data_operators(tmp_path, without):
    place = str(tmp_path / "copy")
    _copy(place, *without)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"],
        cwd=place, env={**os.environ, "PYTHONPATH": place}, capture_output=True, text=True,
    )
    assert said.returncode == 0, said.stderr[-2000:]
    names = said.stdout.split()
    assert len(names) > 100 and "pipeline" not in names
    assert not [n for n in names if n.startswith("op") and n[2].isdigit()]
