"""The library imports and answers without the text operators and their pipeline."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print(len(q), any(k.startswith('op') for k in q))"


def _run(folder):
    env = {**os.environ, "PYTHONPATH": f"{folder}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"}
    return subprocess.run([sys.executable, "-c", CODE], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def test_entry_without_text_operators(tmp_path):
    shutil.copytree(ROOT / "daymark", tmp_path / "daymark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    # With the pipeline left behind, and without it.
    for _ in range(2):
        done = _run(tmp_path)
        assert done.returncode == 0, done.stderr
        assert done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 60
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
