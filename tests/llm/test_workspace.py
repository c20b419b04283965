import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, ROOT)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from spanwarden.llm import exact_dedup, quality
docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_decisions(spark, docs).collect()) == [(1, 1), (2, 1)]
labels = spark.createDataFrame([], "doc_id long, quality int")
assert quality.keep_good(spark, docs, quality.fit(spark, docs, labels)).count() == 2
print("fine")
"""


def test_without_a_checkpoint_folder():
    """Local sessions that set no folder get one of their own, and workers find the package from anywhere."""
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.replace("ROOT", repr(root))], capture_output=True, text=True, cwd="/", env=env, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
