import random

import pytest

from spanwarden.llm import line_dedup


def brute(rows, least):
    """Every run of lines of at least ``least`` words that stands earlier, by comparing all places."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, out = {}, {}
    texts = [[s for s in t.split("\n")] for _, _, t in order]
    for k, lines in enumerate(texts):
        real = [i for i, s in enumerate(lines) if s.split()]
        gone = set()
        for a in range(len(real)):
            words = 0
            for b in range(a, len(real)):
                words += len(lines[real[b]].split())
                if words < least:
                    continue
                content = tuple(lines[i] for i in real[a : b + 1])
                at = seen.setdefault(content, (k, real[a], real[b]))
                if at[0] < k or real[a] > at[2]:
                    gone.update(range(real[a], real[b] + 1))
        out[order[k]] = "\n".join(s for i, s in enumerate(lines) if i not in gone)
    return out


def corpus(seed, least):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.choice([1, 2, 5, 9, 20]))) for _ in range(40)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice([rng.choice(passages), [f"own {i} {rng.random()}"], [""], [rng.choice(pool)] * rng.choice([1, 7])])
        rows.append((i, "\n".join(lines)))
    rows += [(None, "\n".join(passages[0])), (99, None), rows[5]]
    return rows


@pytest.mark.parametrize("seed,least", [(1, 12), (2, 12), (3, 5)])
def test_against_brute_force(spark, seed, least):
    rows = corpus(seed, least)
    got = line_dedup.remove_repeats(spark, spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, line int, h int"), least).collect()
    want = brute(rows, least)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        whole = texts[r.doc_id] or ""
        assert r.text == want[r.doc_id is None, r.doc_id or 0, whole], r.doc_id
        assert r.n_lines == len(whole.split("\n"))


def test_long_text_and_one_long_line(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = "\n".join(f"line {i} of the long text" for i in range(30_000))
    rows = [(1, "a\n" + passage + "\nb"), (2, passage), (3, "x\n" + passage[:-1]), (4, long), (5, "intro\n" + long)]
    got = {r.doc_id: r for r in line_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[4].text, got[5].text) == (rows[0][1], "", rows[2][1], long, "intro")
    assert got[2].removed_lines == 1


def test_empty(spark):
    assert line_dedup.remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
