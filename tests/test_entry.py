"""The driver's entry, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_stands_without_the_subpackage(tmp_path, with_pipeline):
    for name in ("__spark_entry__.py", "bench.py", *(["corpus_pipeline.py"] if with_pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(s) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not Path(p).resolve().is_relative_to(ROOT)]
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": os.pathsep.join(known)})
    assert done.returncode == 0, done.stderr


def test_entry_gives_the_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[0] == "k"
