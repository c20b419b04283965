import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
names = set(e.queries())
assert names == set(e.oracle_sql()) and "pipeline" not in names and not any(n.startswith("op") for n in names), names
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", e.entry(spark).count(), e.queries()["doc_verdict"](spark, e.SMOKE).count())
"""


def test_the_rest_works_with_both_folders_gone(tmp_path):
    """The package in a copy without the corpus operators, their tests and the pipeline."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", ".pytest_cache"))
    assert not (copy / "spanwarden" / "llm").exists() and not (copy / "tests" / "llm").exists()
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert "ROWS" in done.stdout, done.stderr[-2000:]
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert found.returncode == 0, found.stdout[-2000:]
