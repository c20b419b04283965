import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanwarden.llm import bytebatch, lm_score


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def stream(text):
    return list(" ".join(tokens(text)).encode()) + [10]


def brute_base(rows):
    train = [t for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    c = Counter(w for t in train for w in tokens(t))
    c[None] = len(train)
    n, v = sum(c.values()), len([k for k in c if c[k]])
    out = []
    for _, t in rows:
        own = [*tokens(t), None]
        out.append((len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    return out, train


class Plain:
    """Prediction by partial matching, one symbol at a time, with sets of excluded symbols."""

    def __init__(self, texts):
        self.after = defaultdict(Counter)
        for t in texts:
            s = [10] * lm_score.ORDER + stream(t)
            for i in range(lm_score.ORDER, len(s)):
                for k in range(lm_score.ORDER + 1):
                    self.after[tuple(s[i - k : i])][s[i]] += 1

    def log10(self, history, symbol):
        out, excluded = 0.0, set()
        for k in range(lm_score.ORDER, -1, -1):
            here = self.after.get(tuple(history[len(history) - k :]))
            if not here:
                continue
            left = {s: n for s, n in here.items() if s not in excluded}
            if not left:
                continue
            total = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / total)
            out += math.log10(len(left) / total)
            excluded |= set(left)
        return out - math.log10(256 - len(excluded))

    def text(self, t):
        s = [10] * lm_score.ORDER + stream(t)
        return sum(self.log10(s[:i], s[i]) for i in range(lm_score.ORDER, len(s)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcÉé𝄞,.") for _ in range(rng.randint(1, 4)))
    pool = [word() for _ in range(60)]
    rows = [(i, rng.choice(["", " "]) + rng.choice([" ", "\n ", "\t"]).join(rng.choice(pool) if rng.random() < 0.9 else word() for _ in range(rng.choice([0, 1, 7, 90])))) for i in range(80)]
    return rows + [(None, "no id"), (200, None), (201, " \n"), (5, rows[5][1]), (203, "A B \x00 \x0b c" + "d" * 3000)]


@pytest.mark.parametrize("piece,bounds", [(1 << 21, {}), (200, {"max_common": 20})])
def test_against_brute_force(spark, monkeypatch, piece, bounds):
    monkeypatch.setattr(bytebatch, "PIECE_BYTES", piece)
    rows = corpus(7)
    want, train = brute_base(rows)
    plain = Plain(train)
    got = lm_score.scores(spark, spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, key string").coalesce(1), **bounds).collect()
    assert len(got) == len(rows)
    a = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got))
    b = sorted(((d is None, d or 0, *w[:3], round(w[3], 6), round(plain.text(t), 6)) for (d, t), w in zip(rows, want, strict=True)))
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], abs=2e-6)


@pytest.mark.parametrize("max_nodes", [5, 300])
def test_contexts_outside_the_trie_score_by_all_counts(spark, max_nodes):
    rows = corpus(7)
    plain = Plain(brute_base(rows)[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.score) for r in lm_score.scores(spark, df, max_nodes=max_nodes).collect())
    want = sorted((d is None, d or 0, plain.text(t)) for d, t in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    texts = pa.array(["".join(chr(c) for c in rng.integers(97, 103, 300)) for _ in range(5)])
    found = [np.unique(lm_score.contexts(p) << 8 | p.symbols, return_counts=True) for p in lm_score.normalised(texts)]
    keys, counts = lm_score._merged(found)
    levels = [lm_score._merged([(keys & ((1 << 8 * (k + 1)) - 1), counts)]) for k in range(lm_score.ORDER + 1)]
    trie = lm_score.Trie(levels)
    for context in [*rng.integers(97, 103, (20, 4)), [10, 10, 10, 10], [1, 2, 3, 4], [97, 98, 200, 99]]:
        code = int.from_bytes(bytes(int(c) for c in context), "big")
        assert (10 ** trie.log10(np.full(256, code), np.arange(256))).sum() == pytest.approx(1)


def test_no_training_and_empty(spark):
    assert lm_score.scores(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_score.scores(spark, spark.createDataFrame([(held, "ab c")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert r.score == pytest.approx(-5 * math.log10(256))


def test_bounded_trie_still_sums_to_one(spark):
    rows = spark.createDataFrame([(i, f"text {i * 7919 % 997} of many words {i}") for i in range(200)], "doc_id long, text string")
    from spanwarden.llm.workspace import Workspace

    model, _ = lm_score.learn(spark, Workspace(spark, "t"), rows, max_nodes=150)
    assert max(len(e.keys) for e in model.trie.entries) <= 150
    for context in (b"text", b"of m", b"    "):
        code = int.from_bytes(context, "big")
        assert (10 ** model.trie.log10(np.full(256, code), np.arange(256))).sum() == pytest.approx(1)


def test_pieces_do_not_matter(monkeypatch):
    texts = pa.array(["One two  three four five six seven eight nine ten " * 3, "", None, "x" * 50 + " y", "a b c d e f g h i j k l m n o p"])

    def whole():
        per = defaultdict(list)
        for p in lm_score.normalised(texts):
            for o, s, c in zip(p.owner, p.symbols, lm_score.contexts(p), strict=True):
                per[int(o)].append((int(s), int(c)))
        return per

    want = whole()
    for size in (7, 13, 30):
        monkeypatch.setattr(bytebatch, "PIECE_BYTES", size)
        assert whole() == want
