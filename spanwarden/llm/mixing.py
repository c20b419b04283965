"""Mixing sources to target weights, with DataFrame functions only.

Sources, in order of code points with null last, weigh 5, 2, 1 and again; together they get 150 % of
all words, no source more than twice its own (the excess is shared again by weight).

The words of a source form one stream (documents in a pseudorandom order) that is cut into blocks of
``BLOCK`` words. A source takes as many slots as its target holds blocks; the last slot is trimmed, so
the words taken are the target rounded down. For each source, a multinomial draw deals its slots over
the output shards, so every shard has a multinomial count of each source and no target is missed: free
draws by shard would miss a small source's by several per cent. Within a source the slots, counted
through the shards, map through a pseudorandom permutation (a Feistel network whose walks stay below
the count) to indexes of pass and block, and blocks of a pass through another; a shard's places are
permuted likewise. Every pass over a source reads each block at most once and no document is taken
more than twice. Slots and blocks meet in a join on (source, block), whose keys are even however large
a source is. Prefix sums of a source run in two levels, over chunks and within them.

Defined cases: null text and text of white space have size 0 and are never taken; null sources are a
source of their own; repeated rows count each; a null id is ordered first; an empty table gives an
empty result. Ids may be of any type. Reruns agree: nothing depends on partitioning but which of
the rows equal in id and text comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import text_of, word_count
from .workspace import Workspace

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 256
SLOTS_PER_SHARD = 4096
SLOTS_PER_TASK = 16_384

ROUNDS, SHORT_WALK, WALK = 4, 6, 64


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _network(x: Column, s: Column, *key: Column) -> Column:
    """A bijection of the numbers of s.l + s.r bits: halves in turn take the exclusive or of a hash of the other."""
    halves = F.struct(F.call_function("shiftrightunsigned", x, s["r"]).alias("a"), x.bitwiseAND(s["low"]).alias("b"))

    def half(acc: Column, i: Column) -> Column:
        left = F.struct(acc["a"].bitwiseXOR(F.xxhash64(acc["b"], *key, i).bitwiseAND(s["high"])).alias("a"), acc["b"].alias("b"))
        right = F.struct(acc["a"].alias("a"), acc["b"].bitwiseXOR(F.xxhash64(acc["a"], *key, i).bitwiseAND(s["low"])).alias("b"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, half, lambda h: F.call_function("shiftleft", h["a"], s["r"]).bitwiseOR(h["b"]))


def permuted(k: Column, n: Column, *key: Column) -> Column:
    """The place of k in a pseudorandom permutation of 0 to n - 1, chosen by key.

    The network permutes the numbers of as many bits as n - 1 has (2 at least); numbers of n or more walk
    on through it until they fall below n, which each step does with a chance of a half or more."""
    bits = F.greatest(F.lit(2), F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))
    one = F.lit(1).cast("long")

    def shape(x: Column) -> Column:
        l, r = F.floor(x["bits"] / 2).cast("int"), (x["bits"] - F.floor(x["bits"] / 2)).cast("int")
        masks = [(F.call_function("shiftleft", one, v) - 1).alias(name) for name, v in (("high", l), ("low", r))]
        return F.struct(x["k"].alias("k"), x["n"].alias("n"), r.alias("r"), *masks)

    def walk(x: Column, s: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda acc, _: F.when(acc < s["n"], acc).otherwise(_network(acc, s, *key)))

    def place(s: Column) -> Column:
        last = lambda x: F.when(x < s["n"], x).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long"))
        far = lambda x: F.when(x < s["n"], x).otherwise(_let(walk(x, s, WALK), last))
        near = lambda x: F.when(x < s["n"], x).otherwise(_let(walk(x, s, SHORT_WALK), far))
        return _let(_network(s["k"], s, *key), near)

    given = F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), bits.alias("bits"))
    return _let(_let(given, shape), place)


def sum_before(rows: DataFrame, key: str, chunk: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the key before each, by chunk and order, in two levels."""
    totals = rows.groupBy(key, chunk).agg(F.sum(value).alias("__sum"))
    upto = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(key, chunk, F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__base"))
    within = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    each = rows.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(base, [key, chunk])
    return each.withColumn(out, F.col("__base") + F.col("__within")).drop("__base", "__within")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_no, source_size, n_docs, target: one row per source."""
    # a few numbers for each source: these windows see sources, never documents
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = each.withColumn("source_no", F.row_number().over(by_name))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))) + 1)
    each = each.withColumn("w", weight).withColumn("cap", MOST * F.col("source_size"))
    all_ = Window.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("w"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("w_full", F.coalesce(F.sum("w").over(before), F.lit(0)))
    level = (SHARE * F.sum("source_size").over(all_) - F.col("full")) / (F.sum("w").over(all_) - F.col("w_full"))
    each = each.withColumn("level", level)
    # the first source, by cap over weight, that its equal share does not fill sets the level of the rest
    each = each.withColumn("level", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("source_no"), F.col("level")))).over(all_)["level"])
    target = F.when(F.col("level").isNull() | (F.col("cap") < F.col("level") * F.col("w")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    return each.select("source", "source_no", "source_size", "n_docs", target.alias("target"))


@dataclass
class Mix:
    """documents: row, doc_id, source, size, source_size, target, off (place in the source's stream).
    slots: source_no, pass, block, words (null: the whole block), shard, place (in the shard).
    spans: row, pass, shard, place, start (word of the document), n (words taken)."""

    documents: DataFrame
    slots: DataFrame
    spans: DataFrame


def draws(sources: DataFrame, n_parts: int) -> DataFrame:
    """source_no, shard, n, base (the source's slots in the shards before), ahead (slots of the sources before
    in the shard), shard_size: a multinomial draw for each source, every slot falling into a shard by a
    hash of its number."""
    runs = sources.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / SLOTS_PER_TASK))))
    runs = runs.repartition(n_parts, "source_no", "run")
    k = F.sequence(F.col("run") * SLOTS_PER_TASK, F.least(F.col("n_slots"), (F.col("run") + 1) * SLOTS_PER_TASK) - 1)
    each = runs.select("source_no", "shards", F.explode(k).alias("k")).withColumn("shard", F.pmod(F.xxhash64("source_no", "k", F.lit(5)), F.col("shards")))
    counts = each.groupBy("source_no", "shard", "shards").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("chunk", F.floor(F.col("shard") / F.ceil(F.sqrt("shards"))))
    counts = sum_before(counts, "source_no", "chunk", ["shard"], "n", "base")
    in_shard = Window.partitionBy("shard").orderBy("source_no")  # a row a source
    ahead = F.coalesce(F.sum("n").over(in_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.sum("n").over(in_shard.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.select("source_no", "shard", "n", "base", ahead.alias("ahead"), size.alias("shard_size"))


def mix(ws: Workspace, sizes: DataFrame, block: int = BLOCK) -> Mix:
    """sizes: a stored table of row (unique), h (a hash that all else follows), doc_id, source, size."""
    sources = ws.save(targets(sizes), "targets")
    chunks = F.ceil(F.sqrt("n_docs"))  # as many chunks as documents in one
    docs = sizes.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # equal rows may be any number and stand for each other: those of one input partition are summed up first
    docs = docs.withColumn("part", F.shiftrightunsigned("row", 33))
    alike = ["source_no", "h", "size", "part"]
    groups = docs.groupBy(*alike, chunks.alias("chunks")).agg((F.count(F.lit(1)) * F.col("size")).alias("words"))
    groups = groups.withColumn("chunk", F.pmod("h", "chunks"))
    groups = sum_before(groups, "source_no", "chunk", ["h", "size", "part"], "words", "first")
    before = F.row_number().over(Window.partitionBy(*alike).orderBy("row")) - 1
    docs = docs.join(groups.select(*alike, "first").hint("merge"), alike).withColumn("off", F.col("first") + before * F.col("size"))
    docs = ws.save(docs.select("row", "doc_id", "source", "size", "source_no", "source_size", "target", "off"), "placed")

    taken = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(taken / F.col("source_size"))).otherwise(0).cast("long")
    rest = taken - passes * F.col("source_size")
    s = sources.select("source_no", passes.alias("passes"), F.ceil(F.col("source_size") / block).alias("blocks"), F.floor(F.col("source_size") / block).alias("whole"), F.floor(rest / block).alias("q"), (rest % block).alias("rem"))
    s = s.withColumn("n_slots", F.col("passes") * F.col("blocks") + F.col("q") + F.when(F.col("rem") > 0, 1).otherwise(0))
    every = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("shards", F.ceil(F.sum("n_slots").over(every) / SLOTS_PER_SHARD))
    s = ws.save(s.filter("n_slots > 0"), "sources")
    # a few rows become many: by a given number of parts, for the few alone would be put into one task
    n_parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    counts = ws.save(draws(s, n_parts), "draws")
    slots = s.join(counts.hint("merge"), "source_no").repartition(n_parts, "source_no", "shard")
    slots = slots.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    place = permuted(F.col("ahead") + F.col("i"), F.col("shard_size"), F.col("shard"), F.lit(5))
    slots = slots.withColumn("k", permuted(F.col("base") + F.col("i"), F.col("n_slots"), F.col("source_no"), F.lit(3))).withColumn("place", place)
    # stored, for the optimiser would copy one permutation into the next
    slots = ws.save(slots.select("source_no", "shard", "place", "k", "passes", "blocks", "whole", "q", "rem"), "indexed")
    slots = slots.withColumn("pass", F.least(F.col("passes"), F.floor(F.col("k") / F.col("blocks"))).cast("long")).withColumn("r", F.col("k") - F.col("pass") * F.col("blocks"))
    last = (F.col("pass") == F.col("passes")) & (F.col("r") == F.col("q"))
    over = F.when(F.col("pass") < F.col("passes"), F.col("blocks")).otherwise(F.greatest(F.col("whole"), F.lit(1)))
    mapped = (F.col("pass") < F.col("passes")) | (F.col("r") < F.col("whole"))
    slots = slots.withColumn("over", over).withColumn("at", F.when(mapped, permuted(F.col("r"), F.col("over"), F.col("source_no"), F.col("pass"))).otherwise(F.col("whole")))
    slots = ws.save(slots.select("source_no", "pass", F.col("at").alias("block"), F.when(last, F.col("rem")).alias("words"), "shard", "place"), "slots")

    pieces = docs.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("off"), F.col("block") * block)
    hi = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("row", "source_no", "block", (lo - F.col("off")).alias("start"), (lo - F.col("block") * block).alias("in_block"), (hi - lo).alias("n"))
    spans = slots.join(pieces.hint("merge"), ["source_no", "block"])  # slots grow with the input: Spark takes them for few, since they are made of few rows
    n = F.when(F.col("words").isNull(), F.col("n")).otherwise(F.least(F.col("n"), F.greatest(F.lit(0).cast("long"), F.col("words") - F.col("in_block"))))
    spans = spans.withColumn("n", n).filter("n > 0").select("row", "pass", "shard", "place", "start", "n")
    return Mix(docs, slots, spans)


def _sizes(docs: DataFrame, row: Column) -> DataFrame:
    """row, h, doc_id, source, size. The order of a source's documents follows from ids and texts alone."""
    h = F.xxhash64("doc_id", text_of("text"))
    return docs.select(row.alias("row"), h.alias("h"), "doc_id", "source", word_count(text_of("text")).alias("size"))  # rows count within partitions, whose number stands above bit 33


def measured(spark: SparkSession, docs: DataFrame) -> tuple[Workspace, DataFrame]:
    ws = Workspace(spark, "mixing")
    numbered = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    return ws, ws.save(_sizes(numbered, F.col("row")), "sizes")


def shares(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    ws, sizes = measured(spark, docs)
    m = mix(ws, sizes)
    taken = m.spans.groupBy("row").agg(F.sum("n").alias("taken"))
    return m.documents.join(taken.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix as documents: one row for each document and pass that takes words of it. A pass that takes
    a whole document repeats its row; one that takes parts of it joins these words by spaces. n_chars,
    where there is such a column, is counted again."""
    ws = Workspace(spark, "mixing")
    stored = ws.save(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    sizes = ws.save(_sizes(stored, F.col("__row")), "sizes")
    m = mix(ws, sizes)
    takes = m.spans.groupBy("row", "pass").agg(F.sum("n").alias("__n"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("__spans"))
    takes = takes.join(m.documents.select("row", F.col("size").alias("__size")).hint("merge"), "row").select(F.col("row").alias("__row"), "__n", "__spans", "__size")
    rows = stored.join(takes.hint("merge"), "__row")
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    part = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["n"].cast("int")))), " ")
    rows = rows.withColumn("text", F.when(F.col("__n") == F.col("__size"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return rows.select(*docs.columns)
