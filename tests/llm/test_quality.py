import random
import zlib

import numpy as np
import pyarrow as pa

from spanwarden.llm import bytebatch, quality


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    syllable = lambda: rng.choice(["ra", "to", "lin", "mé", "ß", "qui"])
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [word() for _ in range(rng.choice([8, 40, 200]))]
        if not good:
            kind = rng.randrange(3)
            words = [w + "$$$" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [w for w in words for _ in range(3)]
        docs.append((i, " ".join(words), "src", "xx", 5))
        if rng.random() < 0.7:
            labels.append((i, int(good), 0))
    truth = {d[0]: not any(x in d[1] for x in ("$$$", "!!")) for d in docs}
    return docs, labels, truth


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, label string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels, _ = corpus()
    d, lab = frames(spark, docs + [(None, None, None, None, None), (10_000, "", "s", "x", 1)], labels)
    rows = quality.score(spark, d, quality.fit(spark, d, lab)).collect()
    assert len(rows) == len(docs) + 2
    by = {r.doc_id: r for r in rows}
    for i, r in by.items():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2)
    held = [(i, q) for i, q, _ in labels if by[i].held_out]
    right = np.mean([by[i].predicted == q for i, q in held])
    assert len(held) > 80 and right > 0.97


def test_scores_depend_on_the_text_alone(spark):
    docs, labels, _ = corpus(2, 300)
    d, lab = frames(spark, docs, labels)
    model = quality.fit(spark, d, lab)
    again = quality.fit(spark, d.repartition(5), lab.repartition(3))
    assert np.array_equal(model.table, again.table) and model.bias == again.bias
    other = spark.createDataFrame([(i + 7, t, None, None, None) for i, t, *_ in docs], "doc_id long, text string, source string, label string, score int")
    a = {r.doc_id: r.score for r in quality.score(spark, d, model).collect()}
    b = {r.doc_id - 7: r.score for r in quality.score(spark, other, model).collect()}
    assert a == b
    # held-out labels are never read
    flipped = [(i, q if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - q, t) for i, q, t in labels]
    assert np.array_equal(quality.fit(spark, d, frames(spark, docs, flipped)[1]).table, model.table)


def test_keep_good_keeps_rows_whole(spark):
    docs, labels, truth = corpus(3, 300)
    d, lab = frames(spark, docs, labels)
    model = quality.fit(spark, d, lab)
    kept = quality.keep_good(spark, d, model)
    assert kept.schema == d.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(spark, d, model).filter("predicted = 1").collect()}


def test_without_labels_and_empty(spark):
    d, _ = frames(spark, [(1, "a", "s", "x", 1)], [])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(spark, d, quality.fit(spark, d, none)).first().score > 0.99
    assert quality.score(spark, d.limit(0), quality.fit(spark, d, none)).count() == 0
    strangers = spark.createDataFrame([(k, k % 2, 0) for k in range(50, 80)], "doc_id long, quality int, toxic int")
    assert 0.3 < quality.score(spark, d, quality.fit(spark, d, strangers)).first().score < 0.7


def test_pieces_do_not_matter(monkeypatch):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 << quality.BUCKET_BITS).astype(np.float32), 0.1)
    texts = pa.array(["one two three four five " * 9, "", None, "wort wort, wort", "x" * 90])
    whole = model.scores(texts)
    monkeypatch.setattr(bytebatch, "PIECE_BYTES", 40)
    cut = model.scores(texts)
    assert np.allclose(whole[1:], cut[1:]) and abs(whole[0] - cut[0]) < 0.2  # a cut text loses the pairs at its cuts


def test_scores_are_means_over_features():
    model = quality.Model(np.arange(1 << quality.BUCKET_BITS, dtype=np.float32) / 1e6, 0.0)
    text = "ab ab c"
    buffer = np.frombuffer((" " + text + " ").encode(), np.uint8)
    feats = quality.feature_ids(buffer, np.array([1, len(buffer)]))
    # 3 words, 2 pairs, and the grams with at most their edges outside a word
    grams = {n: [i for i in range(len(buffer) - n + 1) if b" " not in bytes(buffer[i + 1 : i + n - 1])] for n in quality.GRAMS}
    assert [len(f[0]) for f in feats] == [3, 2, *(len(grams[n]) for n in quality.GRAMS)]
    assert feats[1][0].tolist() == [1, 0]
    ids = np.concatenate([f[0] for f in feats])
    assert model.scores(pa.array([text]))[0] == np.float64(1 / (1 + np.exp(-model.table[ids].astype(float).mean())))


def test_repeated_ids_and_text_ids(spark):
    """An id on any number of rows gives one text to the fit."""
    docs, labels, _ = corpus(3, 200)
    d, lab = frames(spark, docs, labels)
    as_text = lambda df: df.withColumn("doc_id", df.doc_id.cast("string"))
    picked = next(i for i, *_ in labels if zlib.crc32(str(i).encode()) % 4 != 2)
    more = d.filter(d.doc_id == picked)
    for _ in range(6):
        more = more.unionByName(more)
    model, again = quality.fit(spark, d, lab), quality.fit(spark, d.unionByName(more), lab)
    assert np.array_equal(model.table, again.table)
    texts = quality.fit(spark, as_text(d), as_text(lab))
    assert quality.score(spark, as_text(d), texts).count() == len(docs)
