"""Language-model scores: prediction by partial matching over bytes, beside an add-one unigram base.

Both learn from all training documents: those whose crc32 of the id, modulo 7, is not 2. Texts are
normalised as the base's tokens are: A-Z lower-cased, words joined by one space, one end symbol.

Model: counts of all symbols in their contexts of up to ``ORDER`` symbols form a trie. A symbol takes
its share in the longest context known; where it is new there, the model escapes (method C: the number
of different symbols against their count) to the next shorter context, in which the symbols of the
longer one are excluded; below the empty context all symbols left are equally likely. The trie is
fixed after training, so every escape and exclusion is one number per context, and texts are scored in
vectors: one table look-up for nearly every symbol. Contexts within a text start at its beginning.

Counts are summed by Spark and all of them are used. The trie where the texts are holds, of each order,
whole contexts of the highest counts with at most ``MAX_NODES`` nodes; a context that it holds has all its
shorter ones there too, so it scores as in the trie of all counts. Occurrences in other contexts, which are
rare by construction, meet their scores in a join on context and symbol; those scores come from joins
with the tables of all counts, one order after the other.

Base: exact counts of all words over all training documents. Words of the highest counts, at most
``MAX_COMMON`` of them, are looked up where the texts are; occurrences of other words meet their counts
in a join on the word's hash, whose keys are rare by construction.

Defined cases: null and empty texts are the end token alone; a null id counts as the empty text in the
held-out rule; repeated rows are scored alike and each counts; without training documents counts are
zero and symbols equally likely; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebatch
from .bytebatch import IS_SPACE, LOWER, pieces, word_hashes, words
from .text import id_residue
from .workspace import Workspace

ORDER = 4
END = 10
MAX_NODES = 1 << 21
MAX_COMMON = 1 << 20
BITS = 8
#: Of a piece, a dozen vectors of 8 bytes a symbol stand in memory at once.
LM_PIECE_BYTES = 1 << 19
TEXTS_PER_BATCH = 2000


@dataclass
class Piece:
    """Normalised symbols of some texts: their places in the batch, and the words' hashes."""

    symbols: np.ndarray
    owner: np.ndarray  # text of each symbol
    before: np.ndarray  # symbols of the text before each, at most ORDER
    lead: np.ndarray  # the last symbols of a text that an earlier piece began
    word_hashes: np.ndarray
    word_owner: np.ndarray


def normalised(column: pa.Array) -> Iterator[Piece]:
    lead, last_owner = np.zeros(0, np.uint8), -1
    stream = pieces(column, min(LM_PIECE_BYTES, bytebatch.PIECE_BYTES))
    current = next(stream, None)
    while current is not None:
        following = next(stream, None)
        buffer, starts, owner = current
        goes_on = following is not None and following[2][0] == owner[-1]
        buffer = LOWER[buffer]
        lo, hi = words(buffer)
        part = np.searchsorted(starts, lo, side="right") - 1
        out = np.where(IS_SPACE[buffer], np.uint8(32), buffer)
        keep = ~IS_SPACE[buffer]
        keep[hi] = True
        # the space after a text's last word is its end; a text without words ends at its own space
        ends = np.zeros(len(owner), np.int64)
        last = np.searchsorted(part, np.arange(len(owner)), side="right") - 1
        has = (last >= 0) & (part[np.maximum(last, 0)] == np.arange(len(owner))) if len(part) else np.zeros(len(owner), bool)
        ends[has] = hi[last[has]]
        ends[~has] = starts[1:][~has] - 1
        if goes_on:
            ends = ends[:-1]
        continues = owner[0] == last_owner
        out[ends] = END
        keep[ends] = True
        at = np.flatnonzero(keep)
        symbols = out[at]
        mine = np.searchsorted(starts, at, side="right") - 1
        first = np.searchsorted(mine, np.arange(len(owner)))
        before = np.minimum(np.arange(len(at)) - first[mine], ORDER)
        if continues:
            before = np.where(mine == 0, np.minimum(before + len(lead), ORDER), before)
        yield Piece(symbols, owner[mine], before, lead if continues else lead[:0], word_hashes(buffer, lo, hi), owner[part] if len(part) else part)
        if goes_on:
            tail = symbols[mine == len(owner) - 1]
            lead = (np.concatenate([lead, tail]) if continues and len(owner) == 1 else tail)[-ORDER:]
            last_owner = owner[-1]
        else:
            lead, last_owner = lead[:0], -1
        current = following


def contexts(piece: Piece) -> np.ndarray:
    """The last ORDER symbols before each symbol, the latest in the low byte, END before a text."""
    symbols = np.concatenate([np.full(ORDER, END, np.uint8), piece.symbols])
    if len(piece.lead):
        symbols[ORDER - len(piece.lead) : ORDER] = piece.lead
    n = len(piece.symbols)
    out = np.zeros(n, np.int64)
    for k in range(ORDER, 0, -1):
        out = out << BITS | np.where(piece.before >= k, symbols[ORDER - k : ORDER - k + n], END)
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(which, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a batch: kind 0 words by hash, kind 1 symbols with their contexts."""
    for batch in batches:
        found: list[list] = [[], []]
        for piece in normalised(batch.column("text")):
            found[0].append(np.unique(piece.word_hashes.view(np.int64), return_counts=True))
            found[1].append(np.unique(contexts(piece) << BITS | piece.symbols, return_counts=True))
            found = [[_merged(parts)] if len(parts) == 4 else parts for parts in found]
        for kind, parts in enumerate(found):
            if parts:
                keys, counts = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts)], names=["kind", "key", "n"])


class Index:
    """Place of a key in a list of different keys, by open addressing; look-ups are vectors."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.table = np.full(1 << self.bits, -1, np.int32)
        left, home = np.arange(len(keys), dtype=np.int32), self._home(self.keys)
        self.probes = 0
        while len(left):
            slot = (home[left] + self.probes) & (len(self.table) - 1)
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            left = left[self.table[slot] != left]
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        home = self._home(keys)
        got = self.table[home].astype(np.int64)
        wrong = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        for probe in range(1, self.probes + 1):
            if not len(wrong):
                break
            got[wrong] = self.table[(home[wrong] + probe) & (len(self.table) - 1)]
            wrong = wrong[(got[wrong] >= 0) & (self.keys[got[wrong]] != keys[wrong])]
        got[wrong] = -1
        return got


class Trie:
    """levels[k]: (keys, counts) of symbols (low byte) after contexts of k symbols."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.entries, self.contexts = [], []
        self.log_count, self.top, self.escape, self.den, self.down = [], [], [], [], []
        totals = []
        for keys, counts in levels:
            of, at = np.unique(keys >> BITS, return_inverse=True)
            total = np.bincount(at, weights=counts, minlength=len(of))
            kinds = np.bincount(at, minlength=len(of)).astype(float)
            totals.append((of, at, total, kinds))
            with np.errstate(divide="ignore"):
                self.log_count.append(np.log10(counts.astype(float)))
            self.top.append(np.log10(counts) - np.log10(total + kinds)[at])
            self.escape.append(np.log10(kinds) - np.log10(total + kinds))
            self.entries.append(Index(keys))
            self.contexts.append(Index(of))
        self.den.append(np.zeros(0)), self.down.append(np.zeros(0))
        for k in range(1, len(levels)):
            # what the shorter context offers once the longer one's symbols are excluded
            of, at, _, kinds = totals[k]
            keys = levels[k][0]
            shorter = (1 << BITS * k) - 1
            parent = self.contexts[k - 1].find((of & (shorter >> BITS)) if k > 1 else np.zeros(len(of), np.int64))
            excluded = levels[k - 1][1][self.entries[k - 1].find(keys & shorter)]
            left = totals[k - 1][2][parent] - np.bincount(at, weights=excluded, minlength=len(of))
            new = totals[k - 1][3][parent] - kinds
            with np.errstate(divide="ignore", invalid="ignore"):
                self.den.append(np.log10(left + new))
                self.down.append(np.where(new > 0, np.log10(new) - np.log10(left + new), 0.0))
        rest = 256 - len(levels[0][0]) if len(levels[0][0]) else 256
        self.uniform = -np.log10(max(1, rest))

    def log10(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 of the probability of each symbol in its context."""
        out = np.zeros(len(symbol))
        todo = np.arange(len(symbol))
        came = np.full(len(symbol), -1, np.int64)  # the longer context escaped from
        for k in range(self.order, -1, -1):
            own = context[todo] & ((1 << BITS * k) - 1)
            entry = self.entries[k].find(own << BITS | symbol[todo])
            hit = entry >= 0
            top = came < 0
            seen, fresh = hit & top, hit & ~top
            out[todo[seen]] += self.top[k][entry[seen]]
            if fresh.any():
                out[todo[fresh]] += self.log_count[k][entry[fresh]] - self.den[k + 1][came[fresh]]
            miss = ~hit
            todo, came, own = todo[miss], came[miss], own[miss]
            if not len(todo):
                return out
            if k < self.order:
                passed = came >= 0
                out[todo[passed]] += self.down[k + 1][came[passed]]
            here = self.contexts[k].find(own)
            starts = (here >= 0) & (came < 0)
            out[todo[starts]] += self.escape[k][here[starts]]
            came = np.where(here >= 0, here, came)
        out[todo] += self.uniform
        return out


@dataclass
class Learnt:
    trie: Trie
    whole: bool  # the trie holds all contexts
    common: Index
    common_log: np.ndarray
    end_log: float
    tokens: int
    types: int


def _bin(count: str) -> Column:
    return F.floor(F.log2(count) * 4).cast("int")


def _least(table: DataFrame, count: str, size: str, most: int) -> int:
    """The least bin of counts from which on the rows have a sum of sizes of ``most`` or less; 0 for all rows."""
    bins = {r.b: r.n for r in table.groupBy(_bin(count).alias("b")).agg(F.sum(F.expr(size)).alias("n")).collect()}
    total, least = 0, None
    for b in sorted(bins, reverse=True):
        if total + bins[b] > most:
            return 10**6 if least is None else least
        total, least = total + bins[b], b
    return 0


def _contexts(entries: DataFrame) -> DataFrame:
    """context, total, kinds of a table of keys and counts."""
    return entries.groupBy(F.shiftright("key", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))


def learn(spark: SparkSession, ws: Workspace, docs: DataFrame, max_nodes: int = MAX_NODES, max_common: int = MAX_COMMON) -> tuple[Learnt, DataFrame]:
    """The model, and the counts of all words (key, n)."""
    model, words_, _ = _learn(ws, docs, max_nodes, max_common)
    return model, words_


def _learn(ws: Workspace, docs: DataFrame, max_nodes: int = MAX_NODES, max_common: int = MAX_COMMON) -> tuple[Learnt, DataFrame, list[DataFrame]]:
    """The model, the counts of all words (key, n), and of each order the counts of all nodes (key, n)."""
    train = docs.filter(id_residue("doc_id", 7) != 2).select("text")
    counts = ws.save(train.mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    words_ = counts.filter("kind = 0").select("key", "n")
    sums = words_.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("types")).first()
    tables = [counts.filter("kind = 1").select("key", "n")]
    for k in range(ORDER - 1, -1, -1):
        nested = tables[0].groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        tables.insert(0, ws.save(nested, f"order-{k}"))
    levels, least = [], 0
    for k, table in enumerate(tables):
        # a shorter context counts as much as the longer one at least, so thresholds that only rise keep it
        least = max(least, _least(_contexts(table), "total", "kinds", max_nodes))
        if least:
            held = _contexts(table).filter(_bin("total") >= F.lit(least))
            table = table.withColumn("context", F.shiftright("key", BITS)).join(held, "context", "left_semi").select("key", "n")
        got = table.toArrow()
        order = np.argsort(got.column("key").to_numpy(), kind="stable")
        levels.append((got.column("key").to_numpy()[order], got.column("n").to_numpy()[order]))
    n_docs = tables[0].filter(F.col("key") == END).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    table = words_.filter(_bin("n") >= F.lit(_least(words_, "n", "1", max_common))).toArrow()
    learnt = Learnt(Trie(levels), least == 0, Index(table.column("key").to_numpy()), np.log10(table.column("n").to_numpy() + 1.0), float(np.log10(n_docs + 1.0)), int(sums.n) + n_docs, int(sums.types) + (n_docs > 0))
    return learnt, words_, tables


def _outside(ws: Workspace, keys: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """key, value: log10 of the probability of each different key's symbol in its context, by all counts.

    gone_n and gone_kinds are what the longer context excludes here: 0 as long as none is known."""
    state = keys.select("key", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("gone_n"), F.lit(0).cast("long").alias("gone_kinds"))
    found = []
    for k in range(ORDER, -1, -1):
        entries, contexts = tables[k].select(F.col("key").alias("own"), "n"), _contexts(tables[k])
        if k:
            shorter = tables[k].select(F.shiftright("key", BITS).alias("context"), F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("own"))
            below = shorter.join(tables[k - 1].select(F.col("key").alias("own"), "n"), "own").groupBy("context").agg(F.sum("n").alias("below"))
            contexts = contexts.join(below, "context")
        else:
            contexts = contexts.withColumn("below", F.lit(0).cast("long"))
        if k < 2:  # at most 256 contexts and 65,536 entries, whatever the input
            entries, contexts = F.broadcast(entries), F.broadcast(contexts)
        rows = state.withColumn("own", F.col("key").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))).withColumn("context", F.shiftright("own", BITS))
        rows = rows.join(contexts, "context", "left").join(entries, "own", "left")
        new = F.col("kinds") - F.col("gone_kinds")
        every = F.col("total") - F.col("gone_n") + new
        step = F.when(F.col("n").isNotNull(), F.log10("n") - F.log10(every)).when(new > 0, F.log10(new) - F.log10(every)).otherwise(0.0)
        rows = rows.select("key", (F.col("value") + step).alias("value"), F.coalesce("below", F.lit(0)).alias("gone_n"), F.coalesce("kinds", F.lit(0)).alias("gone_kinds"), F.col("n").isNotNull().alias("hit"))
        rows = ws.save(rows, f"outside-{k}")
        found.append(rows.filter("hit").select("key", "value"))
        state = rows.filter("not hit").drop("hit")
    out = state.select("key", (F.col("value") - F.log10(F.greatest(F.lit(1), 256 - F.col("gone_kinds")))).alias("value"))
    for part in found:
        out = out.unionByName(part)
    return out


NAMES = ["doc_id", "held_out", "row", "kind", "key", "n", "known", "part", "score"]


def _scorer(shared):
    """Rows of kind 0, one for each text; of kind 1, one for each text and word that is not common; of kind 2,
    one for each text and symbol with a context that is not in the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Learnt = shared.value
        for batch in batches:
            rows, size = batch.column("row").to_numpy(), batch.num_rows
            score, tokens, known, part = np.zeros(size), np.ones(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
            rare: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
            for piece in normalised(batch.column("text")):
                context, symbol, owner = contexts(piece), piece.symbols.astype(np.int64), piece.owner
                if not model.whole:
                    held = model.trie.contexts[ORDER].find(context) >= 0
                    rare[1].append((owner[~held], context[~held] << BITS | symbol[~held]))
                    context, symbol, owner = context[held], symbol[held], owner[held]
                score += np.bincount(owner, weights=model.trie.log10(context, symbol), minlength=size)
                key, of = piece.word_hashes.view(np.int64), piece.word_owner
                tokens += np.bincount(of, minlength=size)
                at = model.common.find(key)
                hit = at >= 0
                known += np.bincount(of[hit], minlength=size)
                part += np.bincount(of[hit], weights=model.common_log[at[hit]], minlength=size)
                rare[0].append((of[~hit], key[~hit]))
            if model.tokens:
                known += 1
                part += model.end_log
            blank = pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(rows), pa.array(np.zeros(size, np.int32)), blank, pa.array(tokens), pa.array(known), pa.array(part), pa.array(score)], names=NAMES)
            for kind, parts in enumerate(rare, 1):
                if not sum(len(p[0]) for p in parts):
                    continue
                of, key = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                order = np.lexsort((key, of))
                of, key = of[order], key[order]
                first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (key[1:] != key[:-1])]))
                times, n = np.diff(np.append(first, len(of))), len(first)
                none = [pa.nulls(n, t) for t in (batch.column("doc_id").type, pa.bool_(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([*none[:2], pa.array(rows[of[first]]), pa.array(np.full(n, kind, np.int32)), pa.array(key[first]), pa.array(times), *none[2:]], names=NAMES)

    return run


def scores(spark: SparkSession, docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    ws = Workspace(spark, "lm-score")
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(limit)
    spark.conf.set(limit, TEXTS_PER_BATCH)
    try:
        return _scores(spark, ws, docs, bounds)
    finally:
        spark.conf.set(limit, usual)


def _scores(spark: SparkSession, ws: Workspace, docs: DataFrame, bounds: dict[str, int]) -> DataFrame:
    model, counts, tables = _learn(ws, docs, **bounds)
    shared = spark.sparkContext.broadcast(model)  # bounded by MAX_NODES an order and MAX_COMMON
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (id_residue("doc_id", 7) == 2).alias("held_out"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, row long, kind int, key long, n long, known long, part double, score double"
    scored = ws.save(rows.mapInArrow(_scorer(shared), schema), "scored")
    rare = scored.filter("kind = 1").select("row", "key", F.col("n").alias("times")).join(counts, "key")
    rare = rare.groupBy("row").agg(F.sum("times").alias("r_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("r_part"))
    out = scored.filter("kind = 0").join(rare, "row", "left")
    score = F.col("score")
    if not model.whole:
        outside = scored.filter("kind = 2").select("row", "key", F.col("n").alias("times"))
        outside = outside.join(_outside(ws, outside.select("key").distinct(), tables), "key")
        out = out.join(outside.groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("outside")), "row", "left")
        score += F.coalesce("outside", F.lit(0.0))
    base = F.col("part") + F.coalesce("r_part", F.lit(0.0)) - F.col("n") * F.lit(float(np.log10(model.tokens + model.types + 1.0)))
    return out.select("doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("r_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
