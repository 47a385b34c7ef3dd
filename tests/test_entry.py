"""The driver's contract: names, stable schemas, and life without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:3] == ["repo", "side", "tool"]


def test_oracles_belong_to_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [[], ["corpus_pipeline.py"]])
def test_the_rest_lives_without_the_training_data_subpackage(tmp_path, gone):
    """A whole copy loses both folders, with or without the pipeline, and imports, collects its tests and answers a query."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in ("lintmill/llm", "tests/llm"):
        shutil.rmtree(copy / name, ignore_errors=True)
    for name in gone:
        (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert set(e.oracle_sql()) == set(q)"
    env = {"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider"], cwd=copy, env=os.environ | env, check=True, stdout=subprocess.DEVNULL)
