"""The entry module without the parts that a deployment may leave out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"


@pytest.fixture
def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "timberline", tmp_path / "timberline", ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


def shown(folder):
    return subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, capture_output=True, text=True)


def test_without_the_corpus_operators(copy):
    whole = shown(copy)
    assert whole.stdout.split()[3] == "True"
    shutil.rmtree(copy / "timberline" / "llm", ignore_errors=True)
    for leave in (lambda: None, lambda: (copy / "corpus_pipeline.py").unlink(missing_ok=True), lambda: (copy / "timberline" / "llm" / "__pycache__").mkdir(parents=True)):
        leave()
        assert shown(copy).stdout.split()[1:] == ["False", "False", "True"]


def test_broken_parts_are_not_hidden(copy):
    part = copy / "timberline" / "llm" / "common.py"
    if not part.exists():
        pytest.skip("nothing to break")
    part.unlink()
    assert "ModuleNotFoundError" in shown(copy).stderr


def test_missing_libraries_leave_the_rest(copy):
    (copy / "xxhash.py").write_text("raise ModuleNotFoundError('no xxhash', name='xxhash')")
    assert shown(copy).stdout.split()[1:] == ["False", "False", "True"]
