"""Removal of repeated runs of lines by winnowing over line hashes, with DataFrame functions only.

A run of consecutive lines that stands earlier in the corpus (by document id, then line) is deleted
where it stands again, if it holds ``LEAST_WORDS`` words or more.

* Winnowing: every line opens a window, the fewest lines from it on that hold ``LEAST_WORDS`` words;
  the line with the least hash of each window is a fingerprint. Every repeated run of that length
  holds a whole window, so both of its places select the same fingerprint: none can be missed.
* Positions are joined on the fingerprint's hash; fingerprints that stand once fall away, which are
  nearly all.
* Around the fingerprints left, matches extend both ways: windows that run forward and windows that
  run backward, and contain such a fingerprint, are compared by two hashes of their lines with the
  first place of the same content. Forward and backward windows together cover a repeated run from
  its first line to its last, so the extent is exact although no two places are ever paired: each
  later place meets the first one only, and a passage in a third of all documents costs a row for each.

Windows run within a document, so the lines (hashes, not text) of one very long text are one task's work.

Within one document a later place counts only where it doesn't overlap the first. Lines of no words
count for nothing by themselves and go with a run around them.

Defined cases: null text is returned as empty; a null id is last in order; rows that repeat an id and
its text are one document and are all returned alike; empty tables give empty results; columns of
other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import word_count
from .workspace import Workspace

LEAST_WORDS = 50
#: Parts that the places of one content are dealt over when they meet its first place.
SALTS = 32

DOC = ["g", "h"]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key (g, h) of the id and the text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).withColumn("g", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.lit(5), "text"))


def lines_of(rows: DataFrame) -> DataFrame:
    """g, h, doc_id, line, words, h1, h2, lo, hi: lines with words; lo and hi are word offsets."""
    each = rows.select(*DOC, "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "said")).withColumn("words", word_count(F.col("said"))).filter("words > 0")
    each = each.select(*DOC, "doc_id", "line", "words", F.xxhash64("said").alias("h1"), F.xxhash64("said", F.lit(17)).alias("h2")).dropDuplicates([*DOC, "line"])
    hi = F.sum("words").over(Window.partitionBy(*DOC).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    return each.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("words"))


def _content(frame) -> list[Column]:
    return [F.xxhash64(F.collect_list(h).over(frame)).alias(k) for h, k in (("h1", "k1"), ("h2", "k2"))]


def repeated_runs(ws: Workspace, rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """g, h, first, last (line numbers): the runs to delete, merged where they touch."""
    lines = ws.save(lines_of(rows), "lines")
    ahead = Window.partitionBy(*DOC).orderBy("lo").rangeBetween(0, least - 1)
    behind = Window.partitionBy(*DOC).orderBy("hi").rangeBetween(-(least - 1), 0)

    windows = lines.withColumn("n", F.sum("words").over(ahead)).withColumn("mark", F.min(F.struct("h1", "line")).over(ahead)).filter(F.col("n") >= least)
    marks = windows.select(*DOC, F.col("mark.line").alias("line"), F.col("mark.h1").alias("mark")).distinct()
    marks = ws.save(marks, "marks")
    again = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("mark")
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = marks.withColumn("salt", F.pmod(F.xxhash64("g", "h", "line"), F.lit(SALTS)).cast("int"))
    places = ws.save(dealt.join(again.hint("merge"), ["mark", "salt"], "left_semi").select(*DOC, "line", F.lit(1).alias("matched")), "places")

    some = lines.join(places.select(*DOC).distinct(), DOC, "left_semi").join(places, [*DOC, "line"], "left")
    who = [*DOC, "doc_id"]
    forward = some.select(*who, F.col("line").alias("first"), F.max("line").over(ahead).alias("last"), F.sum("words").over(ahead).alias("n"), F.max("matched").over(ahead).alias("matched"), *_content(ahead))
    backward = some.select(*who, F.min("line").over(behind).alias("first"), F.col("line").alias("last"), F.sum("words").over(behind).alias("n"), F.max("matched").over(behind).alias("matched"), *_content(behind))
    spans = forward.unionByName(backward).filter((F.col("n") >= least) & (F.col("matched") == 1)).drop("n", "matched").distinct()
    spans = ws.save(spans, "spans")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("g"), F.col("h"), F.col("first"), F.col("last"))
    origins = spans.groupBy("k1", "k2").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("places")).filter("places > 1")
    same = (F.col("origin.g") == F.col("g")) & (F.col("origin.h") == F.col("h"))
    origins = origins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = spans.withColumn("salt", F.pmod(F.xxhash64("g", "h", "first"), F.lit(SALTS)).cast("int"))
    later = salted.join(origins.hint("merge"), ["k1", "k2", "salt"]).filter(~same | (F.col("first") > F.col("origin.last"))).select(*DOC, "first", "last").distinct()

    order = Window.partitionBy(*DOC).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = later.withColumn("new", F.when(F.col("first") <= reach + 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*DOC, "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def remove_repeats(spark: SparkSession, docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, removed_lines, runs (array of first and last line), text without the runs."""
    ws = Workspace(spark, "line-dedup")
    rows = keyed(docs)
    runs = repeated_runs(ws, rows, least).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    runs = ws.save(runs, "runs")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.exists("runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    # the same plan at every size: a few runs would be broadcast, many not
    out = rows.join(runs.hint("merge"), DOC, "left").withColumn("text_lines", F.size(lines))
    removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1), F.lit(0))
    return out.select("doc_id", F.col("text_lines").cast("long").alias("n_lines"), removed.cast("long").alias("removed_lines"), "runs", F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
