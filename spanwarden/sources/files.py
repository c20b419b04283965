"""Files at rest: a scan of paths, its text and JSON reports, and the evidence sink."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import detect
from ..rules import SHIPPED, Rule


def _left_out(name: str) -> bool:
    """Whether Spark's reader passes over files and folders of this name."""
    dropped = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return dropped and not name.startswith(("_common_metadata", "_metadata"))


def hidden_files(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The files below the paths that Spark's reader leaves out for their name or that of a folder, such as
    ``.env``. As with Spark's own listing, names are held by the driver, contents are not."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for path in paths:
        local = path.removeprefix("file://") if path.startswith("file:///") else path
        if "://" not in local and os.path.isfile(local):
            out += [os.path.abspath(local)] if _left_out(os.path.basename(local)) else []
            continue
        if "://" not in local and os.path.exists(local):
            local = os.path.abspath(local)
            for folder, _, names in os.walk(local):
                hidden = any(_left_out(x) for x in os.path.relpath(folder, local).split(os.sep) if x != ".")
                out += [os.path.join(folder, n) for n in names if hidden or _left_out(n)]
            continue
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            continue
        if not fs.getFileStatus(root).isDirectory():
            out += [fs.makeQualified(root).toString()] if _left_out(root.getName()) else []
            continue
        base = fs.makeQualified(root).toString().rstrip("/") + "/"
        files = fs.listFiles(root, True)
        while files.hasNext():
            name = files.next().getPath().toString()
            if any(_left_out(x) for x in name.removeprefix(base).split("/")):
                out.append(name)
    return out


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content of files by path, one at a time."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            fs, name = (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(name, compression=None) as source:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([source.read()], pa.binary())], names=["path", "content"])


def scan_paths(spark: SparkSession, paths: Sequence[str], rules: Sequence[Rule] = SHIPPED, apart: bool | str = False) -> DataFrame:
    """path, findings of every file at or below the paths, whatever its name; an unreadable path fails the
    scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", False)
    files = reader.load(list(paths)).select("path", "content")
    if hidden := hidden_files(spark, paths):
        n = min(len(hidden), int(spark.conf.get("spark.sql.shuffle.partitions")))
        named = spark.createDataFrame([(x,) for x in hidden], "path string").repartition(n, "path")
        files = files.unionByName(named.mapInArrow(_contents, "path string, content binary"))
    return detect(files.select(F.regexp_replace("path", "^file:(//(?=/))?", "").alias("path"), "content"), "content", rules, apart=apart).select("path", "findings")


def dirty(results: DataFrame) -> DataFrame:
    return results.filter(F.size("findings") > 0)


def text_lines(results: DataFrame) -> DataFrame:
    """path, n, line: the text report of the files with findings, in order of path and n."""
    head = F.array(F.concat(F.col("path"), F.lit(":")))
    rows = F.transform("findings", lambda f: F.format_string("  offset %d-%d  %s  %s  %.2f", f["start"], f["end"], f["rule_id"], f["class"], f["confidence"]))
    return dirty(results).select("path", F.posexplode(F.concat(head, rows)).alias("n", "line"))


def json_rows(results: DataFrame) -> DataFrame:
    """path, value: a JSON object for each file with findings."""
    return dirty(results).select("path", F.to_json(F.struct("path", "findings")).alias("value"))


def print_text(results: DataFrame) -> Iterator[str]:
    for r in text_lines(results).orderBy("path", "n").toLocalIterator():
        yield r.line


def print_json(results: DataFrame) -> Iterator[str]:
    """The JSON report, an array of a line for each file with findings; one at a time is in memory."""
    lines = (r.value for r in json_rows(results).orderBy("path").toLocalIterator())
    before = "["
    for line in lines:
        yield before + line
        before = ","
    yield "]" if before == "," else "[]"


def ledger_lines(entries: DataFrame) -> DataFrame:
    """value: evidence rows as JSON lines; keys without a value are left out."""
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("value"))


def append_ledger(entries: DataFrame, folder: str) -> None:
    """Evidence rows as JSON lines, added to a folder."""
    ledger_lines(entries).write.mode("append").text(folder)


def put_ledger(entries: DataFrame, folder: str, run: str) -> None:
    """The evidence of one run, in place of an earlier attempt of the same run."""
    ledger_lines(entries).write.mode("overwrite").text(f"{folder.rstrip('/')}/run={run}")
