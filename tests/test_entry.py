"""The entry module with and without the training-data subpackage."""

from __future__ import annotations

import ast
import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_queries_without_the_subpackage(tmp_path, also):
    gone = {"llm", ".git", "__pycache__", *also}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda _, names: gone & set(names))
    code = "import json, __spark_entry__ as e; print(json.dumps([list(e.queries()), list(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, capture_output=True, text=True, check=True)
    names, sql = json.loads(out.stdout.splitlines()[-1])
    assert len(names) > 100 and "search_chunks" in names and not any(n.startswith("op1_") for n in names) and "pipeline" not in names
    assert set(sql) <= set(names)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert len(entry.entry(spark).columns) == 4


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "lucidex").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path
