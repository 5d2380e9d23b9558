"""The library stands without the text subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

_CODE = """
import __spark_entry__ as e
named = set(e.queries())
assert named and e.oracle_sql() and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in named)
print(len(named))
"""


def _copy(to: Path) -> Path:
    for name in ("terrane", "tests", "__spark_entry__.py", "bench.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, to / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, to / name)
    return to


def _names(folder: Path) -> int:
    done = subprocess.run([sys.executable, "-c", _CODE], cwd=folder, check=True, timeout=120, capture_output=True, text=True)
    return int(done.stdout.split()[-1])


def test_entry_without_the_text_folders(tmp_path):
    """Both folders and the pipeline really go."""
    copy = _copy(tmp_path)
    shutil.rmtree(copy / "terrane" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _names(copy) > 100


def test_entry_where_the_text_folder_cannot_be_imported(tmp_path):
    copy = _copy(tmp_path)
    if (copy / "terrane" / "llm").exists():
        (copy / "terrane" / "llm" / "shared.py").write_text("import a_library_that_is_not_there\n")
    assert _names(copy) > 100


def test_nothing_else_imports_it():
    for path in (ROOT / "terrane").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
