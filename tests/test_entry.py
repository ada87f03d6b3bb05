"""The driver's contract without the training-data part."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["wakeline/llm"], ["wakeline/llm", "corpus_pipeline.py"]])
def test_the_library_stands_alone(tmp_path, gone):
    shutil.copytree(ROOT / "wakeline", tmp_path / "wakeline", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        at = tmp_path / name
        shutil.rmtree(at, ignore_errors=True)
        at.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and not any(x == 'pipeline' or x.startswith('op1_') for x in q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert out.returncode == 0 and int(out.stdout) >= 100, out.stderr
