"""Detection: an Arrow pass over a text column that adds each row's findings as an array.

Findings stay in their row, so detection has no shuffle whatever their number. The column goes to the
matcher as Arrow buffers and each batch is scanned once (``functions.matcher.ColumnMatcher``). The pass is
marked as not deterministic: else the optimiser would repeat it in the filters that it infers from
``explode`` and from conditions on findings. So filters on other columns belong before ``detect``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matcher import ColumnMatcher
from ..rules import SHIPPED, Rule

FINDING = "struct<start:int,end:int,rule_id:string,class:string,confidence:double>"
FINDINGS = f"array<{FINDING}>"

ARROW_FINDINGS = pa.list_(
    pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("rule_id", pa.string()), pa.field("class", pa.string()), pa.field("confidence", pa.float64())])
)


def byte_chars(column: Column, binary: bool = False) -> Column:
    """One character a byte, so that offsets of characters are offsets of bytes."""
    return F.decode(column if binary else F.encode(column, "UTF-8"), "ISO-8859-1")


def candidates(column: Column, rules: Sequence[Rule]) -> Column:
    """Offsets in a text or binary column where windows of the rules open, in order."""
    matcher = ColumnMatcher(rules)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return matcher.anchor_lists(texts)

    return run.asNondeterministic()(column)


def found(column: Column, rules: Sequence[Rule] = SHIPPED, apart: bool | str = False) -> Column:
    """The findings of a text or binary column, by start, end and rule. Null has none. With ``apart`` no
    finding lies within an earlier match of its rule (``ColumnMatcher``)."""
    matcher = ColumnMatcher(rules, apart=apart)

    @F.arrow_udf(FINDINGS)
    def run(texts: pa.Array) -> pa.Array:
        return matcher.findings(texts, ARROW_FINDINGS)

    return run.asNondeterministic()(column)


def detect(df: DataFrame, column: str = "text", rules: Sequence[Rule] = SHIPPED, out: str = "findings", apart: bool | str = False) -> DataFrame:
    """Adds ``out``: the findings of a text or binary column."""
    return df.withColumn(out, found(F.col(column), rules, apart) if rules else F.array().cast(FINDINGS))


def exploded(df: DataFrame, keys: list[str], findings: str = "findings") -> DataFrame:
    """One row per finding: the keys, rule_id, class, start, end_, confidence."""
    return df.select(*keys, F.explode(findings).alias("f")).select(*keys, "f.rule_id", "f.class", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end_"), "f.confidence")
