"""Near-duplicate classes by an LSH forest of MinHash signatures.

Sketch: each text's distinct shingles of five words become 64-bit hashes; ``SIGNATURE`` salted minima
form its signature. Texts with one shingle set collapse to their smallest id at once.

Forest: ``TREES`` sorted orders. Tree t orders all texts by the minima of their signatures from place
4t on (``LONGEST`` of them, then the id); the orders are range-partitioned, so equal and similar
signatures of any number spread over tasks. One pass over each sorted range takes the longest common
prefix of neighbours. Texts whose neighbours have ``DEPTH`` minima in common form a region; a region
of more than ``REGION`` texts is cut along its order into units, whose texts share longer prefixes, so
the depth adapts to each region.

Links are confirmed on full shingle sets, in rounds from deep to shallow prefixes:

1. every text meets the neighbour (the first of those with its longest common prefix) with which it
   shares the longest prefixes, summed over the trees; confirmed links give components, which take in nearly all of a group of copies;
2. every unit that still holds several components is resolved exactly: the common shingles of all its
   texts are counted by products of incidence matrices, and each text is linked to the first text that
   it reaches within the unit. A unit emits a row for each text at most, never its pairs;
3. a region of several units that still holds several components is resolved exactly too: each text
   outside the largest component meets every text of the region, in blocks of two slots of about
   ``REGION`` texts.

So any two texts that share a region are in one component or were compared. A pair at the threshold of
0.75 shares the first 4 minima of none of 32 trees with a chance of 5 in 1,000,000, which falls fast with
likeness. Components are distributed large-star/small-star rounds.

Defined cases: words are what lies between white space after lower-casing A-Z; fewer than five words
are one shingle; null or empty texts have no shingle and are linked with nothing. Repeated ids count
as one document with each of their texts; null ids are never linked. An empty table gives an empty
result. Ids may be of any type that orders. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebatch import LOWER, mix64, pieces, word_hashes, words
from .components import components
from .workspace import Workspace

SHINGLE = 5
SIGNATURE = 128
TREES = 32
DEPTH, LONGEST = 4, 8
REGION = 1024
#: Parts that the rows of one region are dealt over when they meet what was found for it.
SALTS = 8
COLUMNS = 4096
NUM, DEN = 75, 100

_rng = np.random.default_rng(20240601)
_MUL = (_rng.integers(1, 1 << 32, SIGNATURE, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint64).astype(np.uint32)
_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    for buffer, starts, owner in pieces(column):
        buffer = LOWER[buffer]
        at, ends = words(buffer)
        h = word_hashes(buffer, at, ends)
        cut = np.searchsorted(at, starts)
        for k, doc in enumerate(owner):
            hashes[doc].append(h[cut[k] : cut[k + 1]])
    out = []
    for parts in hashes:
        h = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        n = min(SHINGLE, len(h))
        if not n:
            out.append(h)
            continue
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s = s * _STEP + h[k : len(h) - n + 1 + k]
        out.append(np.unique(mix64(s)))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 2048):
        part = _MUL[:, None] * low[None, k : k + 2048] + _ADD[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "digest", "sig"],
        )


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, SIGNATURE)


def _order_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, place for every text and tree: the tree and LONGEST minima, as bytes that sort like numbers."""
    width = 1 + 4 * LONGEST
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            sig, n = _signatures(part.column("sig")), part.num_rows
            rows = np.zeros((TREES, n, width), np.uint8)
            for tree in range(TREES):
                minima = sig[:, (tree * DEPTH + np.arange(LONGEST)) % SIGNATURE]
                rows[tree, :, 0] = tree
                rows[tree, :, 1:] = np.ascontiguousarray(minima.astype(">u4")).view(np.uint8).reshape(n, -1)
            offsets = np.arange(0, (TREES * n + 1) * width, width, dtype=np.int32)
            places = pa.BinaryArray.from_buffers(pa.binary(), TREES * n, [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([part.column("id")] * TREES), places], names=["id", "place"])


def _places(column: pa.Array) -> np.ndarray:
    width = 1 + 4 * LONGEST
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[at : at + len(column) * width].reshape(-1, width)


def common_minima(places: np.ndarray) -> np.ndarray:
    """How many leading minima each place has in common with the one before it; 0 in another tree."""
    same = np.zeros(len(places), np.int32)
    tree = places[1:, 0] == places[:-1, 0]
    equal = (places[1:, 1:] == places[:-1, 1:]).reshape(-1, LONGEST, 4).all(axis=2)
    same[1:] = np.where(tree, np.cumprod(equal, axis=1).sum(axis=1), 0)
    return same


def _region_keys(places: np.ndarray) -> np.ndarray:
    """A 64-bit key of the tree and the first DEPTH minima."""
    key = mix64(places[:, 0].astype(np.uint64) + np.uint64(1 << 20))
    minima = np.ascontiguousarray(places[:, 1:]).view(">u4").astype(np.uint64)
    for k in range(DEPTH):
        key = mix64(key * _STEP + minima[:, k])
    return key.view(np.int64)


def _pass(size: int):
    """id, region, unit, before, common of a sorted range: the region that a text shares with a neighbour,
    the unit of it, the first of the texts before it that have its longest common prefix, and the minima in
    it (all these are neighbours of one prefix; with the first of them links make stars, not chains). Texts
    without a neighbour go, but for those at the ends of the range, whose neighbours may lie beyond."""
    depths = range(DEPTH, LONGEST + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None  # place and position in its region of the row before
        begun = None  # a row that has no neighbour so far
        heads = None  # for each depth the id of the text that began the run of that many minima in common
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, places = batch.column("id"), _places(batch.column("place"))
            common = common_minima(places if last is None else np.concatenate([last[0], places]))[-n:]
            start, index = common < DEPTH, np.arange(n)
            opened = np.maximum.accumulate(np.where(start, index, -1))
            position = np.where(opened >= 0, index - opened, index + (0 if last is None else last[1] + 1))
            region = _region_keys(places)
            unit = mix64(region.view(np.uint64) + np.uint64(part) * _STEP + (position // size).astype(np.uint64)).view(np.int64)
            known = pa.concat_arrays([pa.nulls(len(depths), ids.type) if heads is None else heads, ids])
            source = np.zeros((len(depths), n), np.int64)
            for row, depth in enumerate(depths):
                run_start = np.maximum.accumulate(np.where(common < depth, index, -1))
                source[row] = np.where(run_start >= 0, run_start + len(depths), row)
            of = source[np.clip(common - DEPTH, 0, None), index]
            before = known.take(pa.array(np.where(start, 0, of), mask=start))
            heads = known.take(pa.array(source[:, -1]))
            shown = ~start | np.append(~start[1:], False)
            shown[0] |= last is None
            rows = pa.RecordBatch.from_arrays([ids, pa.array(region), pa.array(unit), before, pa.array(common.astype(np.int32))], names=["id", "region", "unit", "before", "common"])
            if begun is not None and not start[0]:
                yield begun
            yield rows.filter(pa.array(shown))
            begun = rows.slice(n - 1) if start[-1] and not shown[-1] else None
            last = (places[-1:], int(position[-1]))
        if begun is not None:
            yield begun

    return run


def neighbours(spark: SparkSession, reps: DataFrame) -> DataFrame:
    """id, region, unit, before, common of all trees."""
    kind = dict(reps.dtypes)["id"]
    rows = reps.select("id", "sig").mapInArrow(_order_rows, f"id {kind}, place binary")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, "place", "id").sortWithinPartitions("place", "id")
    return sorted_.mapInArrow(_pass(REGION), f"id {kind}, region long, unit long, before {kind}, common int")


def _salted(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a row for each of some keys; one key may be that of most rows."""
    copies = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), [key, "salt"], how).drop("salt")


def _several(labelled: DataFrame, key: str) -> DataFrame:
    """The units or regions of several components; of those with the same texts, as different trees give, one."""
    groups = labelled.groupBy(key).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    return groups.filter("lo != hi").groupBy("size", "x", "y").agg(F.min(key).alias(key)).select(key)


def blocks(labelled: DataFrame) -> DataFrame:
    """id, region, others, x, y: blocks of at most about REGION texts in which any two texts of a region
    meet whose labels differ. A text of the most frequent label stands once for each slot of the others,
    so rows grow with the region's size times the slots that the others fill."""
    half = max(1, REGION // 2)
    labels = labelled.groupBy("region", "label").agg(F.count(F.lit(1)).alias("n"))
    main = labels.groupBy("region").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("size"))
    rows = _salted(labelled, main, "region").withColumn("other", F.col("label") != F.col("main.label"))
    rows = rows.withColumn("k_main", F.ceil(F.col("main.n") / half)).withColumn("k_other", F.ceil((F.col("size") - F.col("main.n")) / half))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("id", F.lit(7)), F.when(F.col("other"), F.col("k_other")).otherwise(F.col("k_main"))))
    slot, block = F.col("slot"), lambda others, x, y: F.struct(F.lit(others).alias("others"), x.alias("x"), y.alias("y"))
    of_main, of_other = F.sequence(F.lit(0).cast("long"), F.col("k_main") - 1), F.sequence(F.lit(0).cast("long"), F.col("k_other") - 1)
    with_main = F.transform(of_main, lambda s: block(False, s, slot))
    with_others = F.transform(F.filter(of_other, lambda s: s != slot), lambda s: block(True, F.least(s, slot), F.greatest(s, slot)))
    at = F.when(F.col("other"), F.concat(with_main, with_others)).otherwise(F.transform(of_other, lambda s: block(False, slot, s)))
    return rows.select("id", "region", F.explode(at).alias("at")).select("id", "region", "at.*")


def _linked(table: pa.Table) -> pa.Table:
    """The classes within one region: each text with the first text that it reaches over links of at
    least the threshold, found on full shingle sets."""
    ids = table.column("id").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    size, n = np.array([len(x) for x in sets]), len(ids)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    held = np.diff(np.append(new, len(values)))
    shared = np.repeat(held > 1, held)
    owner, column = owner[shared], np.repeat(np.arange((held > 1).sum()), held[held > 1])
    common = np.zeros((n, n), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        block = np.zeros((n, COLUMNS), np.float32)
        block[owner[lo:hi], column[lo:hi] - k * COLUMNS] = 1
        common += block @ block.T
    both = common.astype(np.int64)
    alike = DEN * both >= NUM * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(alike, True)  # shingles of one text alone are not among the columns
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    least = rank
    while True:
        nearest = np.where(alike, least[None, :], n).min(axis=1)
        if (nearest == least).all():
            break
        least = nearest
    first = np.sort(ids)[least]
    keep = first != ids
    return pa.table({"a": first[keep], "b": ids[keep]})


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = DEN * common >= NUM * (len(x) + len(y) - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def confirmed(ws: Workspace, sets: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    kind = dict(sets.dtypes)["id"]
    pairs = ws.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"pairs-{name}")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return ws.save(both.mapInArrow(_confirm, f"a {kind}, b {kind}").distinct(), f"links-{name}")


def near_classes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    ws = Workspace(spark, "near-dedup")
    kind = dict(docs.dtypes)["doc_id"]
    sketch = ws.save(docs.select("doc_id", "text").mapInArrow(_sketch, f"doc_id {kind}, n_shingles long, digest binary, sig binary"), "sketch")
    classes = sketch.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = ws.save(classes, "classes")
    known = sketch.select(F.col("doc_id").alias("id"), "digest", F.col("n_shingles").alias("n"), "sig")
    # a class is an id and a digest; an id given to several texts may stand for several classes
    reps = ws.save(known.join(classes, ["id", "digest"]).dropDuplicates(["id", "digest"]), "reps")
    near = ws.save(neighbours(spark, reps), "neighbours")

    wanted = near.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi").mapInArrow(_shingle_rows, f"id {kind}, set binary")
    sets = ws.save(texts, "sets")

    votes = near.filter(F.col("common") >= DEPTH).groupBy("before", "id").agg(F.sum("common").alias("votes"))
    best = votes.groupBy("id").agg(F.max_by("before", F.struct("votes", "before")).alias("before"))
    links = confirmed(ws, sets, best.select(F.col("id").alias("a"), F.col("before").alias("b")), "votes")
    found = ws.save(components(ws, links, "star-votes"), "components-votes")
    label = F.coalesce("label", "id").alias("label")
    labelled = near.join(found, "id", "left").select("unit", "id", label)
    rows = labelled.join(_several(labelled, "unit"), "unit", "left_semi").select("unit", "id").join(sets, "id")
    rest = ws.save(rows.groupBy("unit").applyInArrow(_linked, f"a {kind}, b {kind}"), "links-units")
    links = links.unionByName(rest)
    found = ws.save(components(ws, links, "star-units"), "components-units")
    labelled = near.join(found, "id", "left").select("region", "unit", "id", label)
    # one row a unit decides which regions are more than one unit
    units = labelled.groupBy("region", "unit").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.count(F.lit(1)).alias("units")).filter("units > 1").select("region")
    cut = ws.save(_salted(labelled, units, "region", "left_semi").drop("unit"), "cut")
    large = ws.save(_salted(cut, _several(cut, "region"), "region", "left_semi"), "large")
    if not large.isEmpty():
        rows = blocks(large).hint("merge").join(sets, "id")
        rest = ws.save(rows.groupBy("region", "others", "x", "y").applyInArrow(_linked, f"a {kind}, b {kind}"), "links-blocks")
        found = ws.save(components(ws, links.unionByName(rest), "star-blocks"), "components-blocks")
    ws.drop("sets", "neighbours", "cut")

    of_class = classes.join(found, "id", "left").select("digest", F.coalesce("label", "id").alias("label"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; all columns as they were."""
    kept = near_classes(spark, docs).filter("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
