"""The entry point without the document operators, and without a library that only they use."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from ticketlens.catalog import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder, code=LIST):
    out = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    return [line.split() for line in out.stdout.splitlines()]


def copy_of_tree(to, *without):
    for name in ("ticketlens", "__spark_entry__.py", "corpus_pipeline.py", "tests"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, to / name, ignore=lambda d, names: [n for n in names if n in without or n == "__pycache__"])
        elif name not in without and (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)


def test_without_the_document_operators(tmp_path):
    copy_of_tree(tmp_path, "llm", "corpus_pipeline.py")
    assert listed(tmp_path) == [sorted(QUERIES), sorted(ORACLES)]
    out = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stdout[-2000:]


def test_pipeline_left_behind(tmp_path):
    """The pipeline's file without the operators it calls."""
    copy_of_tree(tmp_path, "llm")
    assert listed(tmp_path) == [sorted(QUERIES), sorted(ORACLES)]


def test_without_a_library(tmp_path):
    copy_of_tree(tmp_path)
    code = "import sys; sys.modules['zstandard'] = sys.modules['public_tokenizers'] = None; " + LIST
    assert listed(tmp_path, code) == [sorted(QUERIES), sorted(ORACLES)]


def test_ticket_queries_are_all_there():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
