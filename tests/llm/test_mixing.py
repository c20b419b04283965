import random

import pytest
from pyspark.sql import functions as F

from spanwarden.llm import mixing


def water(sizes):
    """Targets by repeated sharing of what full sources leave."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] for s in full} | share
        full |= over


def documents(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        n = rng.choice([0, 1, 5, 60, 300, 2000])
        source = rng.choice(["hot"] * 8 + ["b", "C", "ä", "Z", "tiny", None])
        text = rng.choice([None, " \t"]) if n == 0 else " ".join(f"w{i}_{k}" for k in range(n if source != "tiny" else 3))
        rows.append((i, text, source, 7))
    rows += [(900, "same row", "b", 7)] * 2 + [(None, "no id here", "b", 7)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_against_brute_force(spark, seed):
    rows, df = documents(spark, seed)
    got = mixing.shares(spark, df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water(sizes)
    by = {}
    source_of = {r[0]: r[2] for r in rows}
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        by[s] = by.get(s, 0) + r.taken
    assert by == {s: int(t + 1e-9) for s, t in want.items()}
    assert sorted(map(str, got)) == sorted(map(str, mixing.shares(spark, df.repartition(3)).collect()))


def test_documents_hold_what_was_taken(spark):
    rows, df = documents(spark, 3)
    taken = {r.doc_id: r.taken for r in mixing.shares(spark, df).filter("doc_id < 900").collect()}
    out = mixing.mixed_documents(spark, df)
    assert out.columns == df.columns
    clash = df.select("*", *(F.lit(1).alias(c) for c in ("row", "pass", "target", "start", "n", "off")))
    assert mixing.mixed_documents(spark, clash).columns == clash.columns
    words, whole = {}, {r[0]: r[1] for r in rows}
    for r in out.filter("doc_id < 900").collect():
        part = r.text.split()
        assert set(part) <= set(whole[r.doc_id].split()) and len(set(part)) == len(part)
        words[r.doc_id] = words.get(r.doc_id, 0) + len(part)
    assert words == {d: n for d, n in taken.items() if n}


def test_shard_draws_are_multinomial(spark, monkeypatch):
    """Every shard's places are filled once; counts of a source in the shards have the mean and the variance
    of a multinomial draw; totals are what the targets ask for."""
    monkeypatch.setattr(mixing, "SLOTS_PER_SHARD", 50)
    rows, df = documents(spark, 4)
    ws, sizes = mixing.measured(spark, df)
    m = mixing.mix(ws, sizes, block=4)
    slots = m.slots.toPandas()
    assert len(slots) > 5000
    for _, part in slots.groupby("shard"):
        assert sorted(part["place"]) == list(range(len(part)))
    assert not slots.duplicated(["source_no", "pass", "block"]).any()
    counts = slots.groupby(["shard", "source_no"]).size().unstack(fill_value=0)
    n_shards = len(counts)
    for s in counts.columns:
        total = counts[s].sum()
        if total < 1000:
            continue
        mean = total / n_shards
        assert counts[s].mean() == pytest.approx(mean)
        assert 0.6 * mean < counts[s].var() < 1.5 * mean * (1 - 1 / n_shards), s
    # neighbours in a shard are no neighbours in their source
    hot = slots[slots.source_no == slots.source_no.mode()[0]].sort_values(["shard", "place"])
    steps = hot["block"].diff().dropna()
    assert steps.value_counts(normalize=True).iloc[0] < 0.02


def test_permutations(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 100, 1000, 4097)], "n long").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    both = sizes.select("n", *(mixing.permuted(F.col("k"), F.col("n"), F.lit(7), F.lit(k)).alias(f"p{k}") for k in (1, 2)), "k").toPandas()
    for n, part in both.sort_values("k").groupby("n"):
        assert sorted(part.p1) == list(range(n)) == sorted(part.p2)
        if n > 30:
            assert (part.p1 == part.p2).mean() < 0.2 and part.p1.diff().value_counts(normalize=True).iloc[0] < 0.2


def test_many_rows_without_an_id_and_text_ids(spark):
    rows = [(None, f"a b c {i % 3}", "s") for i in range(300)] + [(f"id{i}", "x " * 50, "t") for i in range(40)]
    got = mixing.shares(spark, spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    assert len(got) == 340 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert sum(r.taken for r in got if r.doc_id is None) == int(got[0].target) if got[0].doc_id is None else True


def test_a_very_long_text(spark):
    rows = [(1, "w " * 300_000, "a"), (2, "v " * 10, "a"), (3, None, "b")]
    got = {r.doc_id: r for r in mixing.shares(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1].size == 300_000 and got[1].taken + got[2].taken == int(got[1].target)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.shares(spark, empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in mixing.shares(spark, blank).collect()] == [(0, 0, 0.0)] * 2
