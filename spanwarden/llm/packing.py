"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A document's tokens are the tokenizer's ids and one separator; only longer ones are cut, into pieces
of the capacity. Packing is bulk-synchronous best fit:

1. Pieces are range-sorted by length (then id) across the cluster and ranked within their length.
2. In every superstep all lengths with pieces left look up their successor among the gaps (the
   smallest gap that holds them) in one sweep over both sorted lists; conflicts over a gap are
   resolved by rank, the longer pieces first; gaps are updated; the losers take part in the next
   superstep. Lengths without a successor open new sequences, the longest first.
3. Pieces find their sequence and offset by successor search of their rank in the placements.

Equal lengths are interchangeable and so are equal gaps, so supersteps work on runs (a length or a
gap with a range of ranks or sequence numbers): at most ``capacity`` runs of lengths and of gaps
whatever the number of documents. They run in one task of an executor, for a corpus takes more than a
thousand of them and as jobs of their own they would take longer than all else. The documents stay
distributed; a length that a third of all pieces share is split by id in the range sort.

Tokens come from a public tokenizer file whose path is a parameter. It drops white space and never
joins across it, so texts are tokenised word by word through a bounded table.

Defined cases: a null or empty text is the separator alone; repeated rows and ids are packed once for
each row; null ids are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebatch import LOWER, pieces, word_hashes, words
from .workspace import Workspace

CAPACITY = 2048
SEPARATOR = 0
TABLE_WORDS = 1_500_000

ASCII_ALNUM = np.zeros(256, bool)
ASCII_ALNUM[[*range(48, 58), *range(97, 123)]] = True

_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of whole texts.

    Words are looked up by their hash in a table of known words, all words of a piece of text at once.
    ASCII letters are lower-cased first, as the tokenizer does, and a full stop or comma behind an ASCII
    letter or digit is a word of its own, as in the tokenizer. New words of letters only are encoded in
    one call: each of them gives one run of tokens that ends with a word end. A full table starts anew.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocab.values()) + 1, bool)
        self.word_end[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self._reset()

    @staticmethod
    def at(path: str) -> WordTokenizer:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        return _tokenizers[path]

    def _reset(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _encode(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the new words one after the other, and their number for each word."""
        texts = [w.decode("utf-8", "replace") for w in new]
        plain = np.array([t.isalpha() for t in texts], bool)
        ids: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(new)
        joined = [t for t, p in zip(texts, plain.tolist(), strict=True) if p]
        if joined:
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(joined)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.word_end[got]) + 1
            if len(ends) == len(joined) and ends[-1] == len(got):
                if len(joined) == len(new):
                    return got, np.diff(ends, prepend=0)
                for i, part in zip(np.flatnonzero(plain).tolist(), np.split(got, ends[:-1]), strict=True):
                    ids[i] = part
            else:
                plain[:] = False
        for i in np.flatnonzero(~plain).tolist():
            ids[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def _learn(self, hashes: np.ndarray, new: list[bytes]) -> None:
        got, count = self._encode(new)
        if self.used + len(got) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(got)), np.uint32)])
        self.flat[self.used : self.used + len(got)] = got
        first = self.used + np.cumsum(count) - count
        self.used += len(got)
        place = np.searchsorted(self.keys, hashes)
        self.keys, self.first, self.count = (np.insert(x, place, y) for x, y in ((self.keys, hashes), (self.first, first), (self.count, count)))

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow column, as unsigned 32-bit integers."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(column)
        for buffer, starts, owner in pieces(column):
            buffer = LOWER[buffer]
            lo, hi = words(buffer)
            last, before = buffer[hi - 1], buffer[hi - 2]
            stop = np.flatnonzero((hi - lo > 1) & ((last == 44) | (last == 46)) & ASCII_ALNUM[before])
            hi[stop] -= 1
            lo, hi = np.insert(lo, stop + 1, hi[stop]), np.insert(hi, stop + 1, hi[stop] + 1)
            known, place, which = np.unique(word_hashes(buffer, lo, hi), return_index=True, return_inverse=True)
            if len(self.keys) + len(known) > TABLE_WORDS or self.used > 8 * TABLE_WORDS:
                self._reset()
            row = np.searchsorted(self.keys, known)
            missing = np.ones(len(known), bool)
            missing[row < len(self.keys)] = self.keys[row[row < len(self.keys)]] != known[row < len(self.keys)]
            if missing.any():
                raw, at = buffer.tobytes(), place[missing]
                self._learn(known[missing], [raw[x:y] for x, y in zip(lo[at].tolist(), hi[at].tolist(), strict=True)])
                row = np.searchsorted(self.keys, known)
            count = self.count[row][which]
            end = np.cumsum(count)
            source = np.repeat(self.first[row][which] - (end - count), count)
            source += np.arange(len(source))
            got = self.flat[source]
            cut = np.concatenate([[0], end])[np.searchsorted(lo, starts)].tolist()
            for k, doc in enumerate(owner.tolist()):
                part = got[cut[k] : cut[k + 1]]
                out[doc] = part if not len(out[doc]) else np.concatenate([out[doc], part])
        return out


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = WordTokenizer.at(tokenizer_path), np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(tok.ids(batch.column("text"))):
                data = ids.astype("<u4").tobytes() + end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row.append(i), piece.append(k), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int, int]:
    """Placements (length, first rank, end rank, first sequence, pieces a sequence, offset), the number
    of sequences and of supersteps, for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c}
    if any(n > capacity or n < 1 for n in left):
        raise ValueError("a piece is longer than the capacity")
    done = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    placed: list[tuple[int, int, int, int, int, int]] = []
    opened = steps = 0

    def fill(n: int, gap: int, lo: int, hi: int) -> None:
        """Pieces of length n into sequences lo to hi, which all have this gap."""
        each = gap // n
        full = min(hi - lo, left[n] // each)
        rest = left[n] - full * each if full < hi - lo else 0
        for first, last, k in ((lo, lo + full, each), (lo + full, lo + full + 1, rest)):
            if k and last > first:
                take = (last - first) * k
                placed.append((n, done[n], done[n] + take, first, k, capacity - gap))
                done[n] += take
                left[n] -= take
                if gap - k * n:
                    gaps.setdefault(gap - k * n, []).append((first, last))

    while any(left.values()):
        steps += 1
        free = sorted(g for g, runs in gaps.items() if runs)
        wishes: dict[int, list[int]] = {}
        without: list[int] = []
        for n in sorted((n for n, c in left.items() if c), reverse=True):
            k = bisect.bisect_left(free, n)
            wishes.setdefault(free[k], []).append(n) if k < len(free) else without.append(n)
        for gap, lengths in wishes.items():
            runs = gaps.pop(gap)
            for n in lengths:  # by rank: the longer come first
                while runs and left[n]:
                    lo, hi = runs.pop()
                    used = min(hi - lo, -(-left[n] // (gap // n)))
                    if used < hi - lo:
                        runs.append((lo + used, hi))
                    fill(n, gap, lo, lo + used)
            if runs:
                gaps.setdefault(gap, []).extend(runs)
        for k, n in enumerate(without):
            if k and 2 * n <= capacity:
                break
            new = -(-left[n] // (capacity // n))
            fill(n, capacity, opened, opened + new)
            opened += new
    return np.array(placed, np.int64).reshape(-1, 6), opened, steps


RUNS = ("length", "rank", "rank_end", "sequence", "each", "place")
RUN_SCHEMA = ", ".join(f"{c} long" for c in RUNS)


def _planner(capacity: int):
    """The supersteps over all lengths (length, n), as the runs of ``plan``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            counts |= dict(zip(*(batch.column(c).to_pylist() for c in ("length", "n")), strict=True))
        placed, _, _ = plan(dict(sorted(counts.items())), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(placed[:, k]) for k in range(len(RUNS))], names=list(RUNS))

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ws = Workspace(spark, "packing")
    pieces = ws.save(pieces_of(docs, tokenizer_path, capacity), "pieces")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = pieces.repartitionByRange(n, "length", "doc_id", "piece", "start", "ids_crc32").withColumn("part", F.spark_partition_id())
    sorted_ = ws.save(sorted_, "sorted")
    by_part = sorted_.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = ws.save(by_part.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "by-part")
    lengths = by_part.groupBy("length").agg(F.sum("n").alias("n"))  # at most ``capacity`` rows
    placed = ws.save(lengths.repartition(1).mapInArrow(_planner(capacity), RUN_SCHEMA), "placed").toArrow()
    table = np.stack([placed.column(c).to_numpy() for c in RUNS], axis=1).reshape(-1, len(RUNS))
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    # a part holds a range of lengths: about as many rows as parts and lengths
    before = {(r.part, r.length): r.before for r in by_part.collect()}
    shared = spark.sparkContext.broadcast((table, before))  # runs, as bounded as the lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, part, rank = (batch.column(c).to_numpy() for c in ("length", "part", "rank"))
            pairs, which = np.unique(part.astype(np.int64) << 32 | length, return_inverse=True)
            rank = rank - 1 + np.array([base[int(p >> 32), int(p & 0xFFFFFFFF)] for p in pairs], np.int64)[which]
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            at = rank - row[:, 1]
            sequence, offset = row[:, 3] + at // row[:, 4], row[:, 5] + at % row[:, 4] * length
            out = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = sorted_.withColumn("rank", F.row_number().over(within).cast("long"))
    fields = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")
