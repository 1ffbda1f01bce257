import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(root, cwd):
    code = "import __spark_entry__ as e, json; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    import json

    return json.loads(subprocess.run([sys.executable, "-c", code], cwd=cwd, env={"PYTHONPATH": str(root), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout)


def test_the_rest_imports_without_the_text_operators(tmp_path):
    for keep_pipeline in (False, True):
        root = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "llm", *[] if keep_pipeline else ["corpus_pipeline.py"], "__pycache__"))
        queries, oracles = names(root, tmp_path)
        assert len(queries) > 100 and not any(n.startswith("op1") or n == "pipeline" for n in queries)
        assert set(oracles) <= set(queries)


def test_nothing_else_names_the_text_operators():
    for path in (ROOT / "tonelake").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tonelake.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
