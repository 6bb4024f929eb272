"""The driver's module without the llm subpackage, and errors that it must not hide."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()) > 5)"


def copy(tmp_path, *without: str) -> Path:
    target = tmp_path / "copy"
    shutil.copytree(REPO, target, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in without:
        path = target / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return target


def ask(where: Path) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=where, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("without", [("maskwright/llm", "tests/llm"), ("maskwright/llm", "tests/llm", "corpus_pipeline.py")])
def test_imports_without_the_subpackage(tmp_path, without):
    done = ask(copy(tmp_path, *without))
    assert done.stdout.split() == ["0", "False", "True"], done.stderr


def test_other_missing_modules_are_errors(tmp_path):
    if not (REPO / "maskwright/llm").exists():
        pytest.skip("the subpackage is not there")
    where = copy(tmp_path)
    (where / "maskwright/llm/broken.py").write_text("import no_such_module_at_all\n")
    queries = where / "maskwright/llm/queries.py"
    queries.write_text("from maskwright.llm import broken\n" + queries.read_text().replace("from __future__ import annotations\n", ""))
    done = ask(where)
    assert done.returncode and "no_such_module_at_all" in done.stderr
