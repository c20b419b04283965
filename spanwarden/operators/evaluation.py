"""Scoring of the detector on a labelled corpus, and the quality gate."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..rules import SHIPPED, Rule
from .detect import detect

ENTRY = "rule_id string, class string, input string, expect_finding boolean, description string"
FLOOR, SLACK = 0.80, 0.05


def load_corpus(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for path in sorted(Path(folder).rglob("*.yaml")):
        for e in (yaml.safe_load(path.read_text()) or {}).get("entries") or []:
            rows.append((e.get("rule_id"), e.get("class"), str(e.get("input", "")), bool(e.get("expect_finding")), e.get("description")))
    return spark.createDataFrame(rows, ENTRY)


def confusion(entries: DataFrame) -> DataFrame:
    """class, tp, fp, fn, tn of entries (class, expect_finding, fired: array of classes)."""
    own = entries.select("class", F.array_contains("fired", F.col("class")).alias("hit"), "expect_finding")
    own = own.select("class", (F.col("hit") & F.col("expect_finding")).alias("tp"), (F.col("hit") & ~F.col("expect_finding")).alias("fp"), (~F.col("hit") & F.col("expect_finding")).alias("fn"), (~F.col("hit") & ~F.col("expect_finding")).alias("tn"))
    no = F.lit(False)
    other = entries.select(F.explode(F.filter(F.array_distinct("fired"), lambda c: c != F.col("class"))).alias("class"), no.alias("tp"), F.lit(True).alias("fp"), no.alias("fn"), no.alias("tn"))
    return own.unionByName(other).groupBy("class").agg(*(F.sum(F.col(c).cast("long")).alias(c) for c in ("tp", "fp", "fn", "tn")))


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(1.0))


def metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    measured = F.floor(100 * (tp + 1) / (tp + fp + 2)) / 100.0
    return counts.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("measured", measured)


def evaluate_corpus(corpus: DataFrame, rules: Sequence[Rule] = SHIPPED) -> DataFrame:
    found = detect(corpus, "input", rules).withColumn("fired", F.array_distinct(F.transform("findings", lambda f: f["class"])))
    return metrics(confusion(found))


def uncovered(spark: SparkSession, rules: Sequence[Rule], corpus: DataFrame) -> DataFrame:
    """Classes of rules without a positive or without a negative entry, in order."""
    covered = corpus.groupBy("class").agg(F.bool_or("expect_finding").alias("pos"), F.bool_or(~F.col("expect_finding")).alias("neg")).filter("pos and neg")
    classes = spark.createDataFrame(sorted({(r.class_,) for r in rules}), "class string")
    return classes.join(covered, "class", "left_anti").orderBy("class")


def thresholds(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """Least precision of each class: the lowest of its rules' floors."""
    rows = spark.createDataFrame([(r.class_, r.confidence) for r in rules], "class string, confidence double")
    return rows.groupBy("class").agg(F.min(F.greatest(F.col("confidence") - SLACK, F.lit(FLOOR))).alias("min_precision"))


def gate(scored: DataFrame, floors: DataFrame, min_precision: float = 0.80, min_recall: float = 0.80) -> DataFrame:
    """The classes that fail: class, precision, recall, min_precision."""
    joined = scored.join(F.broadcast(floors), "class", "left").withColumn("min_precision", F.coalesce("min_precision", F.lit(min_precision)))  # a row for each class of rules
    return joined.filter((F.col("precision") < F.col("min_precision")) | (F.col("recall") < min_recall)).select("class", "precision", "recall", "min_precision").orderBy("class")


# The layout of the report's columns.
HEAD_FORMAT = "%-36s %7s %7s %5s %5s %5s %5s %8s"
ROW_FORMAT = "%-36s %7s %7s %5d %5d %5d %5d %8.2f"
COLUMNS = ("Class", "Prec", "Recall", "TP", "FP", "FN", "TN", "Confidence")
RULE = ("-----", "----", "------", "--", "--", "--", "--", "----------")

NOTE = ("", "Measured on the entries of the corpus, which hold both kinds on purpose; other text may score", "otherwise. Confidence is what these counts of false positives support.")


def percent(x: Column) -> Column:
    """A share as text with one decimal, of halves the even one; N/A where there is none."""
    # format_string takes halves up, and takes for halves what is only written so
    return F.when(x.isNull() | F.isnan(x), "  N/A").otherwise(F.format_string("%5s%%", F.format_number(x * 100, 1)))


def report_lines(scored: DataFrame) -> DataFrame:
    """class, line: a row of the report for each class."""
    return scored.select("class", F.format_string(ROW_FORMAT, "class", percent(F.col("precision")), percent(F.col("recall")), "tp", "fp", "fn", "tn", "measured").alias("line"))


def report(scored: DataFrame, note: bool = False) -> list[str]:
    """The table of an evaluation, a line for each class; classes are as few as the rules."""
    lines = [r.line for r in report_lines(scored).orderBy("class").collect()]
    return [HEAD_FORMAT % COLUMNS, HEAD_FORMAT % RULE, *lines, *(NOTE if note else ())]


def percentiles(df: DataFrame, column: str, keys: Sequence[str] = (), shares: Sequence[float] = (0.5, 0.99)) -> DataFrame:
    """keys, p50, p99 (by ``shares``): the value at index floor(n * share) of the sorted values, 0 for none.

    Ranks come from counts of equal values, so sorting is by value and not by row."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(*keys).orderBy(column)
    upto = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    placed = counted.withColumn("__to", upto).withColumn("__all", total)
    at = [F.min(F.when(F.col("__to") > F.floor(F.col("__all") * s), F.col(column))).alias(f"p{s * 100:g}") for s in shares]
    found = placed.groupBy(*keys).agg(*at)
    return found.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in found.columns if c not in keys))
