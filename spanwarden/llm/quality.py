"""Quality classifier: supervised subword embeddings.

A text is the average of learned vectors, one for each hashed word, each hashed character n-gram
(bytes of UTF-8, 3 to 5 long, a word's edges count as characters) and each pair of neighbouring words
(the same word twice or not); a softmax over the average gives
the score. Trained by plain numpy stochastic gradient descent in one task.

The fit uses a bounded sample: at most ``MAX_TRAIN`` labelled texts of each class, those with the
smallest hash of their id, each reduced on the executors to bucket counts; weights restore the class
shares counted over all labels. Whole texts are used for fitting and for scoring. Inputs of a score
are the text's bytes and nothing else.

Because the average is linear, a trained model is one number for each bucket (its vector times the
softmax weights): scoring adds table entries and divides by the number of features, vectorised over
Arrow batches.

Defined cases: null and empty texts have no features and score the bias alone; repeated rows score
alike; of rows with one id one text (the least) is learnt from; ids may be of any type; a null id counts
as the empty text in the held-out rule; without labels of both classes every
score is the share of class 1 (1.0 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reach_workers
from .bytebatch import pieces, word_hashes, words
from .text import id_residue

BUCKET_BITS = 18
DIM = 16
GRAMS = (3, 4, 5)
MAX_TRAIN = 1500
STEPS = 20_000
MIN_EPOCHS, MAX_EPOCHS = 4, 40
RATE = 0.4
THRESHOLD = 0.7


def feature_ids(buffer: np.ndarray, edges: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, place of its first byte) for words, for pairs of neighbouring words
    (buckets 0 and 1: different, the same) and for each n-gram length. edges: where pieces start."""
    mask = np.uint32((1 << BUCKET_BITS) - 1)
    starts, ends = words(buffer)
    hashes = word_hashes(buffer, starts, ends)
    out = [((hashes >> np.uint64(7)).astype(np.uint32) & mask, starts)]
    piece = np.searchsorted(edges, starts, side="right")
    pair = np.flatnonzero(piece[1:] == piece[:-1])
    out.append(((hashes[pair + 1] == hashes[pair]).astype(np.uint32), starts[pair + 1]))
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    flat = np.where(space, np.uint8(32), buffer).astype(np.uint32)
    inside = np.zeros(len(buffer) + 1, np.int32)
    np.cumsum(space, out=inside[1:])
    rolling = flat.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(flat) < n:
            break
        rolling = rolling[: len(flat) - n + 1] * np.uint32(0x01000193) + flat[n - 1 :] + np.uint32(n)
        if n not in GRAMS:
            continue
        # no space between the first and the last byte, and not more than one at the edges of a gram
        first = np.flatnonzero((inside[n - 1 : len(flat)] - inside[1 : len(flat) - n + 2]) == 0)
        h = rolling[first]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
        out.append(((h ^ (h >> np.uint32(15))) & mask, first))
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, label, buckets and their counts, as packed bytes, of each text."""
    for batch in batches:
        per: list[dict] = [None] * batch.num_rows
        for buffer, starts, owner in pieces(batch.column("text")):
            feats = feature_ids(buffer, starts)
            cuts = [np.searchsorted(at, starts - 1) for _, at in feats]
            for k, doc in enumerate(owner):
                ids = np.concatenate([f[c[k] : c[k + 1]] for (f, _), c in zip(feats, cuts, strict=True)])
                per[doc] = ids if per[doc] is None else np.concatenate([per[doc], ids])
        packed = [np.unique(p if p is not None else np.zeros(0, np.uint32), return_counts=True) for p in per]
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("label"), pa.array([p[0].astype("<u4").tobytes() for p in packed], pa.binary()), pa.array([p[1].astype("<u4").tobytes() for p in packed], pa.binary())],
            names=["key", "label", "buckets", "counts"],
        )


@dataclass
class Model:
    """score = sigmoid(bias + mean over features of table[bucket])."""

    table: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        total, count = np.zeros(n), np.zeros(n)
        for buffer, starts, owner in pieces(column):
            for ids, at in feature_ids(buffer, starts):
                if not len(ids):
                    continue
                k = np.searchsorted(starts - 1, at, side="right") - 1
                k = np.minimum(k, len(owner) - 1)
                total += np.bincount(owner[k], weights=self.table[ids], minlength=n)
                count += np.bincount(owner[k], minlength=n)
        return 1.0 / (1.0 + np.exp(-(self.bias + total / np.maximum(count, 1))))


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], weights: dict[int, float], seed: int = 7) -> Model:
    """samples: (label, buckets, counts). Two softmax outputs; their difference is what scores use."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIM, 1.0 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    share = [(c / max(1, c.sum())).astype(np.float32) for _, _, c in samples]
    epochs = int(np.clip(STEPS // max(1, len(samples)), MIN_EPOCHS, MAX_EPOCHS))
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            label, ids, _ = samples[i]
            rate = RATE * (1 - done / steps) * weights[label]
            done += 1
            mean = share[i] @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1.0
            back = out.T @ p
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            # every bucket's share of a text is small: the step on vectors is scaled up to match
            vectors[ids] -= (rate * 30.0) * share[i][:, None] * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, max_train: int = MAX_TRAIN) -> Model:
    """Fits on rows of ``docs`` that ``labels`` marks and that are not held out."""
    reach_workers(spark)
    known = (
        labels.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("label"))
        .filter("label in (0, 1) and key is not null").groupBy("key").agg(F.min("label").alias("label"))
        .filter(id_residue("key", 4) != 2)
    )
    shares = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = shares.get(1, 0) / sum(shares.values()) if shares else 1.0
    plain = Model(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    if set(shares) != {0, 1}:
        return plain
    picked = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(max_train)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(picked), "key")  # 2 * max_train rows
    # an id may stand for any number of rows; one text of each is taken, and copies go before the shuffle
    texts = texts.groupBy("key", "label").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(_counts, f"key {dict(docs.dtypes)['doc_id']}, label int, buckets binary, counts binary")
    # at most 2 * max_train rows meet in one task; the driver gets the model alone
    fitted = rows.repartition(1).mapInArrow(_trainer(shares), "bucket_table binary, bias double").first()
    return Model(np.frombuffer(bytes(fitted.bucket_table), np.float32), fitted.bias) if fitted else plain


def _trainer(shares: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(k).to_pylist() for k in ("key", "label", "buckets", "counts")), strict=True)
        if not rows:
            return
        samples = [(lab, np.frombuffer(b, "<u4"), np.frombuffer(c, "<u4")) for _, lab, b, c in sorted(rows)]
        drawn = {k: max(1, sum(s[0] == k for s in samples)) for k in (0, 1)}
        weights = {k: shares[k] / sum(shares.values()) / (drawn[k] / max(1, len(samples))) for k in (0, 1)}
        model = train(samples, weights)
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["bucket_table", "bias"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = reach_workers(spark).sparkContext.broadcast(model)  # 2 ** BUCKET_BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(values, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (id_residue("doc_id", 4) == 2).alias("held_out"), "text")
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double"
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns stay as they are."""
    shared = reach_workers(spark).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = shared.value.scores(batch.column("text")) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
