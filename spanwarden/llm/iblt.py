"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with DataFrame
functions only.

A text's paragraphs (lines, and sentences within lines) become a set of 64-bit digests. A sketch has
3 tables of ``SLOTS`` cells; every digest falls into one cell of each table, where its count, the xor
of the digests and the xor of their checks are kept. Two sketches subtract cell by cell, digests that
both hold cancel, and peeling (taking out the digest of a cell that holds one only, again and again)
recovers the digests that differ.

Where peeling stops short, the pair is sketched again on a larger scale: digests are dealt over so many
sketches that a few differ in each, and sketches that still fail are split by eight with new slots
until none fails. A sketch fails or succeeds by itself, so work follows the size of the difference and
no text, however long, is one large sketch.

Likeness of two sets is their common part over their union, from the recovered difference. A fingerprint
holds the first sketch and the digests that the larger ones are made of, so whoever has two fingerprints
can repeat all of this.

Defined cases: null texts are empty and have no paragraphs; two empty sets are alike (1.0). Every row is
a document, rows that repeat an id too, and those of one id follow by a hash of their text. Ids are
ordered with null last; the next of the last document is the first. Ids are whole numbers; others are
refused. All rows of one id stand in one part. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

SLOTS = 8
TABLES = 3
CELLS = SLOTS * TABLES
PER_SKETCH = 3
SPLIT = 8
MAX_LEVELS = 16

#: A paragraph ends with its line; long ones are taken sentence by sentence.
BREAK = r"\n+|(?<=[.!?])\x20+"
#: Ranges of ids for each shuffle partition, which hash to partitions evenly enough.
PARTS = 3


def digests(text: Column) -> Column:
    parts = F.filter(F.split(text, BREAK), lambda s: F.length(s) > 0)
    return F.array_distinct(F.transform(parts, lambda s: F.xxhash64(s)))


def _places(x: Column, level: int) -> list[Column]:
    """The cells of a digest: one in each table."""
    h = x if level == 0 else F.xxhash64(x, F.lit(level))
    return [F.shiftrightunsigned(h, 5 * t + 7).bitwiseAND(F.lit(SLOTS - 1)).cast("int") + SLOTS * t for t in range(TABLES)]


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(977))


def _placed(signed: Column, level: int) -> Column:
    """(x, sign) with the check c and the places p0, p1, p2."""
    return F.transform(signed, lambda s: F.struct(s["x"].alias("x"), s["sign"].alias("sign"), _check(s["x"]).alias("c"), *(p.alias(f"p{t}") for t, p in enumerate(_places(s["x"], level)))))


def _cell(k: Column, inside: Column) -> Column:
    """Cell k (k, n, x, c) of the digests (x, sign, c) inside it."""
    empty = F.struct(k.cast("int").alias("k"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))
    return F.aggregate(inside, empty, lambda a, s: F.struct(a["k"].alias("k"), (a["n"] + s["sign"]).alias("n"), a["x"].bitwiseXOR(s["x"]).alias("x"), a["c"].bitwiseXOR(s["c"]).alias("c")))


def _inside(placed: Column, k: int) -> Column:
    return F.filter(placed, lambda s: s[f"p{k // SLOTS}"] == F.lit(k))


def _in_use(placed: Column, k: Column) -> Column:
    return F.filter(placed, lambda s: (s["p0"] == k) | (s["p1"] == k) | (s["p2"] == k))


def sketched(df: DataFrame, digests_: str, out: str) -> DataFrame:
    """Adds the sketch of a column of digests: all cells, as a document shows it."""
    df = df.withColumn("__placed", _placed(with_sign(F.col(digests_), 1), 0))
    return df.withColumn(out, F.array(*(_cell(F.lit(k), _inside(F.col("__placed"), k)) for k in range(CELLS)))).drop("__placed")


def small_sketch(placed: Column) -> Column:
    """The cells in use of a sketch of a few placed digests."""
    used = F.array_distinct(F.flatten(F.transform(placed, lambda s: F.array(s["p0"], s["p1"], s["p2"]))))
    return F.transform(used, lambda k: _cell(k, _in_use(placed, k)))


def with_sign(xs: Column, sign: int) -> Column:
    return F.transform(xs, lambda x: F.struct(x.alias("x"), F.lit(sign).alias("sign")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: F.struct(p["k"].alias("k"), (p["n"] - q["n"]).alias("n"), p["x"].bitwiseXOR(q["x"]).alias("x"), p["c"].bitwiseXOR(q["c"]).alias("c")))


def peel(cells: Column, rounds: Column, level: int = 0) -> Column:
    """(cells, found, stuck): what is left of the cells after so many rounds, and the digests taken out,
    as (x, sign). A round takes out the digests of all cells that hold one only; none ends the work."""
    begin = F.struct(cells.alias("cells"), F.array().cast("array<struct<x:bigint,sign:int>>").alias("found"), F.lit(False).alias("stuck"))

    def pure(acc: Column) -> Column:
        alone = F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["x"])))
        return F.array_distinct(F.transform(alone, lambda c: F.struct(c["x"].alias("x"), c["n"].alias("sign"))))

    def less(c: Column, p: Column) -> Column:
        return F.struct(c["k"].alias("k"), (c["n"] - p["sign"]).alias("n"), c["x"].bitwiseXOR(p["x"]).alias("x"), c["c"].bitwiseXOR(p["c"]).alias("c"))

    def step(acc: Column, _: Column) -> Column:
        # a list of one, for its lambda names what the round takes out
        after = F.transform(
            F.array(pure(acc)),
            lambda found: F.transform(
                F.array(_placed(found, level)),
                lambda placed: F.struct(F.transform(acc["cells"], lambda c: F.aggregate(_in_use(placed, c["k"]), c, less)).alias("cells"), F.concat(acc["found"], found).alias("found"), (F.size(found) == 0).alias("stuck")),
            )[0],
        )[0]
        return F.when(acc["stuck"], acc).otherwise(after)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), rounds)), begin, step)


def is_empty(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))


def as_text(cells: Column, digests_: Column) -> Column:
    """``size:cells:digests``: the first sketch, and in order the digests that larger sketches hold where it
    doesn't peel, both in base64. Two such texts alone give the likeness of their documents."""
    hexed = F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"].cast("long")), 8, "0"), F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["c"]), 16, "0")))
    held = F.transform(F.array_sort(digests_), lambda x: F.lpad(F.hex(x), 16, "0"))
    return F.concat(F.size(digests_).cast("string"), *(part for x in (hexed, held) for part in (F.lit(":"), F.base64(F.unhex(F.array_join(x, ""))))))


def differences(ws: Workspace, pairs: DataFrame, keys: list[str], recover: bool = True) -> DataFrame:
    """keys, n (digests that differ) and, with ``recover``, only_a and only_b, for pairs of digest arrays
    a and b. The keys are unique; where pairs are dealt out by one of them, no further shuffle is made
    of their digests."""
    if "sa" not in pairs.columns:
        pairs = sketched(sketched(pairs, "a", "sa"), "b", "sb")
    first = pairs.withColumn("apart", subtract(F.col("sa"), F.col("sb"))).withColumn("p", peel(F.col("apart"), F.lit(CELLS)))
    done = is_empty(F.col("p.cells"))
    items = F.when(~done, F.concat(with_sign(F.col("a"), 1), with_sign(F.col("b"), -1)))
    # no null structs in what is gathered: a pair that is done gathers nothing and keeps what it found
    first = first.select(*keys, F.when(done, F.col("p.found")).alias("found"), F.pow(F.lit(2), F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(F.lit(1), F.size("a") + F.size("b")) / PER_SKETCH)))).cast("long").alias("scale"), items.alias("items"))
    rows = first.select(*keys, "scale", "found", F.explode_outer("items").alias("s"))
    bucket = F.coalesce(F.pmod(F.shiftrightunsigned(F.col("s.x"), 24), F.col("scale")), F.lit(-1))
    kept = None
    for level in range(1, MAX_LEVELS + 1):
        before = [F.first("found").alias("found")] if level == 1 else []
        each = rows.groupBy(*keys, "scale", bucket.alias("bucket")).agg(F.collect_list("s").alias("s"), *before)
        each = each.withColumn("placed", _placed(F.col("s"), level)).withColumn("sketch", small_sketch(F.col("placed"))).withColumn("p", peel(F.col("sketch"), F.size("s"), level)).withColumn("done", is_empty(F.col("p.cells")))
        found = F.coalesce("found", "p.found") if level == 1 else F.col("p.found")
        shown = [F.when(F.col("done"), found if recover else F.size(found)).alias("found")]
        each = ws.save(each.select(*keys, "scale", "bucket", *shown, "done", F.when(~F.col("done"), F.col("s")).alias("s")), f"peeled-{level}")
        part = each.filter("done").select(*keys, "found")
        kept = part if kept is None else kept.unionByName(part)
        left = each.filter("not done")
        if left.isEmpty():
            break
        rows = left.select(*keys, F.xxhash64("scale", "bucket").alias("scale"), F.explode("s").alias("s"))
        bucket = F.pmod(F.xxhash64("s.x", F.lit(level)), F.lit(SPLIT))
    else:
        raise RuntimeError(f"sketches still fail at level {MAX_LEVELS}")
    if not recover:
        return kept.groupBy(*keys).agg(F.sum("found").alias("n"))
    only = lambda sign: F.flatten(F.collect_list(F.transform(F.filter("found", lambda s: s["sign"] == sign), lambda s: s["x"])))
    return kept.groupBy(*keys).agg(F.sum(F.size("found")).alias("n"), only(1).alias("only_a"), only(-1).alias("only_b"))


def likeness(size_a: Column, size_b: Column, n: Column) -> Column:
    return F.when(size_a + size_b + n == 0, F.lit(1.0)).otherwise((size_a + size_b - n) / (size_a + size_b + n))


def in_order(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text, part, ghost: documents dealt into parts, which are ranges of descending ids, so that
    windows of parts see a document and its next. The first document of each part stands once more, as
    a ghost, at the end of the part before it; that of the first part at the end of the last.

    Only limits between parts and one row a part are handled outside the parts."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("documents are ordered by doc_id, which has to be a whole number")
    n = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = F.array(*(F.lit((k + 1) / n) for k in range(n - 1))) if n > 1 else F.array(F.lit(1.0))
    limits = docs.agg(F.percentile_approx("doc_id", steps, 20 * n).alias("q")).first().q or []
    limits = sorted(set(limits), reverse=True)
    # null ids are last, by a hash of their text: as many parts as other ids of their number would have
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    spread = max(1, -(-total.nulls * n // max(1, total.n)))
    part = F.lit(len(limits) + 1) + F.floor((F.xxhash64(F.coalesce("text", F.lit(""))) / F.lit(2.0**64) + 0.5) * spread).cast("int")
    found = F.size(F.filter(F.array(*(F.lit(x) for x in limits)), lambda x: x >= F.col("doc_id"))) if limits else F.lit(0)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("part", F.when(F.col("doc_id").isNull(), part).otherwise(found)).withColumn("h", F.xxhash64("text"))
    order = F.struct((F.col("doc_id").isNull()).alias("no_id"), (-F.col("doc_id")).alias("minus"), "h")
    heads = [r.head for r in rows.groupBy("part").agg(F.min(order).alias("head"), F.first("part").alias("p")).select(F.struct("p", "head").alias("head")).collect()]  # one for each part
    heads.sort(key=lambda r: r.p)
    if not heads:
        return rows.withColumn("ghost", F.lit(False))
    wanted = spark.createDataFrame([(None if r.head.minus is None else -r.head.minus, r.head.h, heads[i - 1].p) for i, r in enumerate(heads)], f"w_id {dict(docs.dtypes)['doc_id']}, w_h long, before int")
    ghosts = rows.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("h") == F.col("w_h"))).dropDuplicates(["before"])
    ghosts = ghosts.select("doc_id", "text", F.col("before").alias("part"), "h", F.lit(True).alias("ghost"))
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)


def edited_pairs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edited text has its last third replaced by the beginning of the next
    document's text. Texts are shuffled once; what follows are digests."""
    ws = Workspace(spark, "fingerprints")
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "h")
    rows = in_order(spark, docs).withColumn("row", F.row_number().over(order)).withColumn("after", F.lead("text").over(order))
    size = F.length("text")
    cut = F.floor(size / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (size - cut).cast("int")), F.substring("after", F.lit(1), cut))
    rows = rows.select("part", "row", "ghost", "doc_id", size.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.coalesce(edited, F.lit(""))).alias("e"))
    rows = ws.save(rows, "digests")

    by_row = Window.partitionBy("part").orderBy("row")
    each = sketched(sketched(rows.select("part", "row", "ghost", "a", "e").repartition("part"), "a", "sa"), "e", "se")
    each = each.withColumn("b", F.lead("a").over(by_row)).withColumn("sb", F.lead("sa").over(by_row)).filter("not ghost")
    other = F.array(F.struct(F.col("e").alias("b"), F.col("se").alias("sb")), F.struct(F.col("b"), F.col("sb")))
    pairs = each.select("part", "row", "a", "sa", F.size("b").alias("next_size"), F.posexplode(other).alias("kind", "o")).select("part", "row", "kind", "next_size", "a", "sa", "o.b", "o.sb")
    n = differences(ws, pairs, ["part", "row", "kind", "next_size"], recover=False)
    n = n.groupBy("part", "row", "next_size").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("n_edited"), F.max(F.when(F.col("kind") == 1, F.col("n"))).alias("n_next"))
    out = rows.filter("not ghost").join(ws.save(n, "counts").hint("merge"), ["part", "row"])
    out = sketched(sketched(out, "a", "sa"), "e", "se")
    size_a, size_e = F.size("a"), F.size("e")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sa"), F.col("a")).alias("fingerprint"), as_text(F.col("se"), F.col("e")).alias("edited_fingerprint"),
        likeness(size_a, size_e, F.col("n_edited")).alias("near_edited"), likeness(size_a, F.col("next_size"), F.col("n_next")).alias("near_next"),
    )
