"""Shared scratch space for jobs of several steps.

Every intermediate table is written under ``spark.checkpoint.dir``, which all executors and the
driver reach, so a lost executor costs a re-read and never a lost result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import reach_workers


_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local folder of this application serves only where that
    is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor reaches")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="shared-")
        root = _own[app]
    return root.rstrip("/")


class Workspace:
    """A folder of intermediate tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = reach_workers(spark)
        self.root = path or f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if path is None:
            atexit.register(self._forget)

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def save(self, df: DataFrame, part: str) -> DataFrame:
        """Writes ``df`` and returns the table read back: lineage ends here."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(part))
        return self.load(part, df)

    def load(self, part: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(part))

    def drop(self, *parts: str) -> None:
        for part in parts:
            self._delete(self.path(part))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def _forget(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may have ended before the interpreter
            pass
