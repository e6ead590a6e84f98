"""The driver's entry points, also without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_imports_without_llm(tmp_path):
    import shutil

    shutil.copytree(ROOT / "cohortry", tmp_path / "cohortry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, m, has = out.stdout.split()
    assert int(n) > 90 and int(m) > 90 and has == "False", out.stderr


def test_errors_inside_llm_show(tmp_path):
    import shutil

    shutil.copytree(ROOT / "cohortry", tmp_path / "cohortry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "cohortry/llm").mkdir()
    run = lambda: subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(e.llm)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run().stdout.strip() == "None"
    (tmp_path / "cohortry/llm/__init__.py").write_text("")
    (tmp_path / "cohortry/llm/queries.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
