"""The entry without the optional parts."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
CHECK = """
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(len(names), sum(n.startswith("op") and n[2:3].isdigit() for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("gone", [["tideline/llm"], ["tideline/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "tideline"):
        if (ROOT / name).is_dir():
            left = [g.rsplit("/", 1)[1] for g in gone if g.startswith(f"{name}/")]
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *left))
        elif name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    own, numbered, pipeline = done.stdout.split()
    assert int(own) > 80 and pipeline == "False"
    assert (int(numbered) == 0) == ("tideline/llm" in gone or not (ROOT / "tideline/llm").exists())


def test_errors_of_other_modules_are_not_hidden(tmp_path):
    for name in ("__spark_entry__.py", "tideline"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    (tmp_path / "tideline" / "llm").mkdir(exist_ok=True)
    (tmp_path / "tideline" / "llm" / "__init__.py").touch()
    (tmp_path / "tideline" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-c", CHECK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
