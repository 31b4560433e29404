from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tracemill.functions import answers

ROOT = Path(__file__).parent.parent


def test_entry_works_without_the_llm_folder(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    told = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    n, pipeline, known = told.stdout.split()
    assert int(n) > 100 and pipeline == "False" and known == "True"


def test_errors_inside_the_llm_folder_are_told(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    folder = tmp_path / "r" / "tracemill" / "llm"
    if folder.exists():
        (folder / "queries.py").write_text("import not_there\n")
        told = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
        assert told.returncode and "not_there" in told.stderr


def test_a_leftover_folder_is_no_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    (tmp_path / "r" / "tracemill" / "llm" / "__pycache__").mkdir(parents=True)
    told = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print('pipeline' in e.queries())"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert told.stdout.strip() == "False"


def test_nothing_else_imports_the_llm_folder():
    found = [p for p in (ROOT / "tracemill").rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]
    assert found == []


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a": 1}', {"a": 1}), ('x {"a": [1, 2, {"b": "c', {"a": [1, 2]}), ('{"a": "x", "b": "unf', {"a": "x"}), ("no object", None), (None, None), ('{"a": "q\\"}", "b": [', {"a": 'q"}'})],
)
def test_repair(text, want):
    got = answers.repaired(text)
    assert (json.loads(got) if got else None) == want


def test_repair_needs_its_fields():
    assert answers.repaired('{"a": 1, "b": 2, "c": ', ("b",)) == '{"a":1,"b":2}'
    assert answers.repaired('{"a": 1, "b": ', ("b",)) is None
