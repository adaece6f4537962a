"""The rest works without the corpus operators and their tests."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for folder in ("millrace/llm", "tests/llm"):
        shutil.rmtree(copy / folder, ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    shutil.copy(os.path.join(ROOT, "bench.py"), copy)
    for pipeline in (False, True):  # whether the pipeline's file is left behind
        if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
            shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), copy)
        code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert 'scan_all' in q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr
