"""Connected components of a link table, distributed: no vertex or link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

MAX_ROUNDS = 60


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(id, label) of every id in ``links`` (a, b): label is the smallest id that it reaches.

    Alternating large-star and small-star rounds, each written to the shared folder; the number of
    rounds grows with the logarithm of a component's size. A vertex with very many links is summed up
    by partial aggregation before its links meet.
    """
    edges = ws.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}-0")
    before = None
    for k in range(1, MAX_ROUNDS + 1):
        # large star: every larger neighbour of u is linked to the least neighbour of u
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour of u, and u, is linked to the least of them
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = ws.save(small.filter("u != v").distinct(), f"{name}-{k}")
        # the links are stars when no vertex is both a centre and a leaf: a check by count and digest
        state = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        ws.drop(f"{name}-{k - 1}")
        edges = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct())
