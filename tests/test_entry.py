"""The driver contract."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry


def test_contract(spark):
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) >= 35
    assert entry.entry(spark).count() > 0


def test_works_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 35 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_library_does_not_import_llm():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "lodestone")):
        if "llm" not in folder.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert "lodestone.llm" not in f.read(), n
