import base64
import hashlib
import random
import re
import struct

import pytest

from spanwarden.llm import iblt
from spanwarden.llm.workspace import Workspace


def parts(text):
    return {s for s in re.split(r"\n+|(?<=[.!?]) +", text or "") if s}


def like(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def brute(rows):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        out.setdefault(d, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(parts(t), parts(edited)), 9), round(like(parts(t), parts(after)), 9)))
    return {d: sorted(x) for d, x in out.items()}


def corpus():
    rng = random.Random(2)
    line = lambda: " ".join("".join(rng.choice("abé𝄞") for _ in range(4)) for _ in range(3)) + rng.choice([".", "", "!"])
    pool = [line() for _ in range(300)]
    rows = []
    for i in range(150):
        n = rng.choice([0, 1, 3, 10, 60, 400])
        rows.append((i * 3, rng.choice([" ", "\n", "\n\n"]).join(rng.choice(pool) if rng.random() < 0.6 else line() for _ in range(n))))
    rows += [(1, None), (2, ""), (4, rows[7][1]), (5, "one. " * 9000 + "\n".join(f"line {k}" for k in range(9000))), (None, "no id. at all")]
    return rows + rows[:3]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_chars int, h string")
    got = iblt.edited_pairs(spark, df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)))
    assert {d: sorted(x) for d, x in by_id.items()} == want
    text = dict(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(text[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    assert len({next(iter(f)) for f in by_text.values()}) == len({frozenset(parts(t)) for t in by_text})


def decoded(text):
    """size, cells (n, x, c) and the set of digests of a fingerprint."""
    size, cells, held = text.split(":")
    raw = base64.b64decode(cells)
    assert len(raw) == 20 * iblt.CELLS
    rows = [struct.unpack(">iqq", raw[k : k + 20]) for k in range(0, len(raw), 20)]
    data = base64.b64decode(held)
    digests = {struct.unpack(">q", data[k : k + 8])[0] for k in range(0, len(data), 8)}
    assert len(digests) == int(size)
    return rows, digests


def test_likeness_follows_from_the_two_texts_alone(spark):
    rows = sorted({r[0]: r for r in corpus() if r[0] is not None}.values(), reverse=True)
    got = {r.doc_id: r for r in iblt.edited_pairs(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    small = 0
    for i, (d, _) in enumerate(rows):
        cells, own = decoded(got[d].fingerprint)
        edited_cells, edited = decoded(got[d].edited_fingerprint)
        _, after = decoded(got[rows[(i + 1) % len(rows)][0]].fingerprint)
        assert round(like(own, edited), 9) == round(got[d].near_edited, 9) and round(like(own, after), 9) == round(got[d].near_next, 9)
        # what differs stands alone in cells of the subtracted sketches, where it is little
        apart = [(p[0] - q[0], p[1] ^ q[1]) for p, q in zip(cells, edited_cells, strict=True)]
        for t in range(iblt.TABLES):
            part = apart[t * iblt.SLOTS : (t + 1) * iblt.SLOTS]
            assert sum(n for n, _ in part) == len(own) - len(edited)
        if len(own ^ edited) == 1:
            small += 1
            assert [x for n, x in apart if n] == [next(iter(own ^ edited))] * iblt.TABLES
    assert small


def test_peeling_recovers_the_differing_digests(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        common = [rng.randrange(-(2**62), 2**62) for _ in range(rng.choice([0, 5, 200]))]
        a, b = ([rng.randrange(-(2**62), 2**62) for _ in range(rng.choice([0, 1, 6, 90]))] for _ in range(2))
        rows.append((i, common + a, b + common[::-1], sorted(a), sorted(b)))
    df = spark.createDataFrame(rows, "k int, a array<long>, b array<long>, x array<long>, y array<long>")
    got = {r.k: r for r in iblt.differences(Workspace(spark, "t"), df.select("k", "a", "b"), ["k"]).collect()}
    for k, _, _, a, b in rows:
        assert (sorted(got[k].only_a), sorted(got[k].only_b), got[k].n) == (a, b, len(a) + len(b))


def test_many_rows_without_an_id(spark):
    rows = [(i, f"line {i}\nshared\nmore {i % 7}") for i in range(60)] + [(None, f"text {i}\nshared") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts_ = iblt.in_order(spark, df).filter("doc_id is null and not ghost").groupBy("part").count().collect()
    assert len(parts_) > 4
    got = iblt.edited_pairs(spark, df).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    with pytest.raises(TypeError):
        iblt.edited_pairs(spark, df.select(df.doc_id.cast("string"), "text"))


def test_empty_and_alone(spark):
    assert iblt.edited_pairs(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = iblt.edited_pairs(spark, spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    assert (alone.near_next, alone.edited_sha256) == (1.0, hashlib.sha256(b"aba").hexdigest())
