import random

import pytest

from spanwarden.llm import near_dedup


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """Smallest id that each row reaches over links of at least 0.75."""
    sets = [shingles(t) for _, t in rows]
    label = {}
    for d, _ in rows:
        label[d] = d
    root = lambda x: x if label[x] == x else root(label[x])
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(rows[i][0]), root(rows[j][0])
                label[max(x, y)] = min(x, y)
    return {(d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True)}


def corpus(seed, n_base=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows = [None, "", " \t", "One", "one", "one two", "ONE TWO  three four five", "one two three four five six"]
    for _ in range(n_base):
        base = [word() for _ in range(rng.choice([4, 30, 120, 400]))]
        if rng.random() < 0.3:
            base += passage
        rows.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 12])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.02, 0.03, 0.04, 0.06]))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(rng.choice([" ", "\n"]).join(copy))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, label string, n int")
    got = near_dedup.near_classes(spark, df).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_regions_go_deeper(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_classes(spark, df).collect()} == brute(rows)


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(f"t{i}" for i in range(120_000))
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "A B c d e f"), (7, long), (6, long + " end"), (8, "x" * 3_000_000)]
    got = near_dedup.near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted([(None, None), (4, 4), (4, 4), (9, 4), (7, 6), (6, 6), (8, 8)], key=str)
    kept = near_dedup.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {None, 4, 6, 8}


def test_forest_finds_all_that_share_a_prefix(spark, monkeypatch):
    """Whatever the ranges: texts whose signatures share the first minima of a tree stand in one region, cut
    into units of a bounded size; what stands alone in all trees is left out but at the ends of ranges."""
    import numpy as np

    monkeypatch.setattr(near_dedup, "REGION", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, (40, near_dedup.SIGNATURE), dtype=np.uint32)
    sigs = []
    for i in range(600):
        sig = base[min(i % 60, 39)].copy()
        changed = rng.random(near_dedup.SIGNATURE) < rng.choice([0.0, 0.1, 0.9])
        sig[changed] = rng.integers(0, 1 << 32, changed.sum(), dtype=np.uint32)
        sigs.append(sig)
    reps = spark.createDataFrame([(f"t{i:03d}", bytearray(s.tobytes())) for i, s in enumerate(sigs)], "id string, sig binary")
    rows = near_dedup.neighbours(spark, reps).collect()
    regions, units = {}, {}
    for r in rows:
        regions.setdefault(r.region, set()).add(r.id)
        units.setdefault((r.region, r.unit), set()).add(r.id)
        if r.common >= near_dedup.DEPTH:
            a, b = sigs[int(r.before[1:])], sigs[int(r.id[1:])]
            assert any((a[t * 4 : t * 4 + 4] == b[t * 4 : t * 4 + 4]).all() for t in range(near_dedup.TREES))
    want = {}
    for i, s in enumerate(sigs):
        for t in range(near_dedup.TREES):
            want.setdefault((t, s[t * 4 : t * 4 + 4].tobytes()), set()).add(f"t{i:03d}")
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    assert want == {frozenset(v) for v in regions.values() if len(v) > 1}
    assert max(map(len, units.values())) <= 8
    assert len([r for r in regions.values() if len(r) == 1]) <= 2 * 8 * near_dedup.TREES


def test_a_region_of_many_unlinked_texts(spark, monkeypatch):
    """One template in all texts, 0.6 to 0.7 alike, so that they share regions but no links; pairs of about 0.78
    among them are all found, though the regions are many times larger than a unit."""
    monkeypatch.setattr(near_dedup, "REGION", 64)
    rng = random.Random(21)
    base = [f"w{i}" for i in range(240)]

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(out)), n):
            out[at] = f"x{rng.randrange(10**9)}"
        return out

    rows = []
    for i in range(300):
        text = edited(base, 5)
        rows.append((2 * i, " ".join(text)))
        rows.append((2 * i + 1, " ".join(edited(text, rng.choice([5, 6])))))
    want = brute(rows)
    assert len({c for _, _, c in want}) > 100
    got = near_dedup.near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want


def test_text_ids(spark):
    rows = [("b", "a b c d e f"), ("a", "A b c d e f"), ("c", "other words that stand alone here"), (None, "a b c d e f")]
    got = near_dedup.near_classes(spark, spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {("a", "a", True), ("b", "a", False), ("c", "c", True), (None, None, True)}


def test_empty(spark):
    assert near_dedup.near_classes(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_large_region_links_to_a_text_that_is_not_first(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]

    def edited(words, places):
        return [f"x{rng.randrange(10**9)}" if at in places else w for at, w in enumerate(words)]

    rows = []
    for i in range(40):
        # edits 5 words apart: members are alike (0.95), a copy is linked to its member (0.756) and to no other (0.718)
        at = rng.sample(range(4, 396, 5), 12)
        member = edited(base, at[:1])
        rows.append((i, " ".join(member)))
        if i >= 28:
            rows.append((1000 + i, " ".join(edited(member, at[1:]))))
    want = brute(rows)
    assert {c for _, _, c in want} == {0}
    got = near_dedup.near_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want


def test_every_two_texts_of_different_components_share_a_block(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "REGION", 8)
    label = {i: 0 if i < 30 else i - i % 3 for i in range(50)}
    given = spark.createDataFrame([(1, i, label[i]) for i in label] + [(2, i, label[i]) for i in range(25, 40)], "region long, id long, label long")
    met = {}
    for r in near_dedup.blocks(given).collect():
        met.setdefault((r.region, r.others, r.x, r.y), set()).add(r.id)
    for region, ids in ((1, range(50)), (2, range(25, 40))):
        together = {(a, b) for (g, *_), m in met.items() if g == region for a in m for b in m}
        assert all((a, b) in together for a in ids for b in ids if label[a] != label[b])
