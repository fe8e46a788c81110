import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

HERE = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60 and len(oracles) > 50 and "csv_column_scan" in queries


def test_everything_else_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(HERE / "specimen", tmp_path / "specimen", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_the_rest_of_the_library_does_not_import_the_corpus_operators():
    for file in (HERE / "specimen").rglob("*.py"):
        if "llm" not in file.relative_to(HERE).parts:
            assert not re.search(r"import.*\bllm\b|\bllm\b.*import", file.read_text()), file
