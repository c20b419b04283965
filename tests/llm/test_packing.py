import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spanwarden.llm import bytebatch, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute_pieces(docs):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    for doc_id, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), packing.CAPACITY):
            part = np.array(ids[k : k + packing.CAPACITY], "<u4")
            yield doc_id, k // packing.CAPACITY, k, len(part), zlib.crc32(part.tobytes())


def gapless(rows, capacity=packing.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_near_the_least(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.choice([1, 50, 5000])):
        n = min(2048, max(1, int(rng.lognormvariate(rng.choice([1, 4, 6]), 1.2))))
        counts[n] = counts.get(n, 0) + rng.choice([1, 1, 40])
    placed, opened, steps = packing.plan(counts)
    assert steps < 2048
    done = dict.fromkeys(counts, 0)
    for n, lo, hi, first, each, offset in placed.tolist():
        assert done[n] == lo and offset + each * n <= 2048 and (hi - lo) % each == 0 and 0 <= first < opened
        done[n] = hi
    assert done == counts
    least = math.ceil(sum(n * c for n, c in counts.items()) / 2048)
    large = sum(c for n, c in counts.items() if 2 * n > 2048)
    assert opened <= max(least, large) * 1.1 + 1


def sequential_best_fit(lengths, capacity=2048):
    """Pieces from long to short, each into the smallest gap that holds it."""
    import bisect

    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        if k == len(gaps):
            gap, opened = capacity, opened + 1
        else:
            gap = gaps.pop(k)
        bisect.insort(gaps, gap - n)
    return opened


@pytest.mark.parametrize("seed", range(8))
def test_plan_against_sequential_best_fit(seed):
    rng = random.Random(100 + seed)
    centre, spread = rng.choice([(3, 1.5), (5, 1.0), (6, 0.6), (6.5, 0.3), (7, 0.5)])
    lengths = [min(2048, max(1, int(rng.lognormvariate(centre, spread)))) for _ in range(rng.choice([30, 800, 6000]))]
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    _, opened, _ = packing.plan(counts)
    assert opened <= 1.01 * sequential_best_fit(lengths) + 1


def test_pack_against_the_tokenizer(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "x", "Straße ÀÉ don't 12 <|endoftext|> é", "word " * 5000, "a" * 3000, "\x0bodd\x1cspace\x85", *("w%d " % i * rng.randint(1, 700) for i in range(60))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, "x"), (3, "x"), (None, "no id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, piece int")
    rows = packing.pack(spark, df, PATH).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    assert got == sorted(brute_pieces(docs), key=str)
    assert gapless(rows) <= math.ceil(sum(r.length for r in rows) / packing.CAPACITY) + 1


@pytest.mark.parametrize("words", [3, 100_000])
def test_word_table_gives_the_same_ids(monkeypatch, words):
    monkeypatch.setattr(bytebatch, "PIECE_BYTES", 150 if words == 3 else 1 << 21)
    monkeypatch.setattr(packing, "TABLE_WORDS", words)
    tok, rng = packing.WordTokenizer(PATH), random.Random(words)
    bits = ["one", "Two", "ÉTÉ", "e\u0301", "İx", "ΣΑΣ", "Straße", "don't", "a.b", ".", ",", "..", "x.,", "1,", "½.", "²", "ﬁ", "한국", "y" * 60, "<|endoftext|>", "'s", "\u00a0", "\u2028", "\x1c", "Ⅷ", "ǅ", "'S.", "\U0001d518"]
    for _ in range(60):
        texts = ["".join(rng.choice([*bits, " ", "\n"]) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 40))) for _ in range(9)]
        want = [tok.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in tok.ids(pa.array(texts))] == want


def test_empty(spark):
    assert packing.pack(spark, spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
