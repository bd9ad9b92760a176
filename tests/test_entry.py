"""The registry with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *e.queries())"


def said(folder):
    out = subprocess.run([sys.executable, "-c", SAY], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)
    assert not out.returncode, out.stderr
    return out.stdout.split()


def test_without_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{HERE}/{name}"):
            shutil.copy(f"{HERE}/{name}", tmp_path)
    shutil.copytree(f"{HERE}/folioscope", tmp_path / "folioscope", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    few = said(tmp_path)
    assert int(few[0]) > 40 and int(few[1]) > 30 and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in few[2:])
    if os.path.exists(tmp_path / "corpus_pipeline.py"):
        os.remove(tmp_path / "corpus_pipeline.py")
        assert said(tmp_path) == few
