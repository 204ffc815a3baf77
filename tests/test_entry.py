"""The registered queries, also where the training-data operators are gone."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"


def names(folder: Path) -> set[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return set(subprocess.run([sys.executable, "-c", NAMES], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split())


def test_the_rest_stands_alone(tmp_path):
    for item in ("__spark_entry__.py", "actloom"):
        if (ROOT / item).is_dir():
            shutil.copytree(ROOT / item, tmp_path / item, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(ROOT / item, tmp_path / item)
    rest = names(tmp_path)
    assert "act_windows" in rest and not any(n.startswith("op") or n == "pipeline" for n in rest)
    # The pipeline may stay behind without the operators that it needs.
    (tmp_path / "corpus_pipeline.py").write_text("import actloom.llm\n")
    assert names(tmp_path) == rest
    assert rest <= names(ROOT)
