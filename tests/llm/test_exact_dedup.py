import hashlib

import pytest
from pyspark.sql import functions as F

from spanwarden.llm import exact_dedup

SCHEMA = "doc_id long, text string, source string, keep_id string"
ROWS = [
    (5, "a  b", "x", "k"),
    (3, "a\tb", None, None),
    (9, "a b", "y", "k"),
    (3, "a b", "z", "k"),  # the id again, with an equal text
    (None, "a b", None, None),
    (1, None, None, None),
    (2, "", None, None),
    (7, "a b", None, None),
    (8, "w " * 50_000, None, None),
    (4, "w  " * 50_000, None, None),
]


def brute(rows):
    norm = lambda t: " ".join(x for x in __import__("re").split("[\\x20\\x09-\\x0D]+", t or ""))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(norm(r[1]), []).append((r[0] is None, r[0] or 0, i))
    return {norm_text: (min(g)[1] if not min(g)[0] else None, len(g)) for norm_text, g in groups.items()}, norm


def check(spark, **options):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.exact_decisions(spark, docs, **options).collect()
    want, norm = brute(ROWS)
    assert len(out) == len(ROWS)
    assert sum(r.kept for r in out) == len(want)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size) for r in out), key=str)
    assert got == sorted(((r[0] is None, r[0] or 0, *want[norm(r[1])]) for r in ROWS), key=str)
    return out


def test_against_brute_force(spark):
    out = check(spark)
    assert bytes(next(r for r in out if r.doc_id == 1).digest).hex() == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("weak", [lambda b: F.unhex(F.lit("00")), lambda b: F.unhex(F.hex(F.pmod(F.length(b), F.lit(2)).cast("int")))])
def test_digest_hits_are_checked_by_bytes(spark, weak):
    check(spark, digest=weak)


def test_state_goes_on_over_ingests(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    dedup = exact_dedup.StreamingDeduplicator(spark)
    dedup.ingest(docs.filter("doc_id > 4"))
    assert {r.keep_id for r in dedup.decisions().filter("group_size = 2").collect()} == {5}
    dedup.ingest(docs.filter("doc_id <= 4 or doc_id is null"))
    want, _ = brute(ROWS)
    assert sorted({(r.keep_id, r.group_size) for r in dedup.decisions().collect()}) == sorted(want.values())


def test_deduplicate_keeps_whole_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.deduplicate(spark, docs)
    assert out.columns == docs.columns
    rows = {(r.doc_id, r.text) for r in out.collect()}
    assert len(rows) == out.count() == 4
    assert {r[0] for r in rows} == {3, 1, 7, 4}


def test_many_rows_without_an_id_and_text_ids(spark):
    """A third of all rows without an id, a third copies of one text: what is compared stays in proportion."""
    rows = [(None, f"text {i % 400}") for i in range(800)] + [(f"c{i}", "one  text") for i in range(800)] + [(f"d{i}", f"own {i}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    dedup = exact_dedup.StreamingDeduplicator(spark)
    dedup.ingest(docs)
    out = dedup.decisions().collect()
    assert len(out) == 2400 and sum(r.kept for r in out) == 400 + 1 + 800
    assert {(r.keep_id, r.group_size) for r in out if r.doc_id is not None and r.doc_id.startswith("c")} == {("c0", 800)}
    assert {r.group_size for r in out if r.doc_id is None} == {2}


def test_a_source_that_comes_in_another_order(spark):
    """Decisions rest on the stored arrivals, not on row numbers of a source that is read again."""
    base = spark.createDataFrame(ROWS, SCHEMA)
    docs = base.repartition(5, F.rand())
    out = exact_dedup.exact_decisions(spark, docs, digest=lambda b: F.unhex(F.lit("00"))).collect()
    want, _ = brute(ROWS)
    assert len(out) == len(ROWS) and sum(r.kept for r in out) == len(want)
    assert sorted({(r.keep_id, r.group_size) for r in out}) == sorted(want.values())


def test_empty(spark):
    assert exact_dedup.exact_decisions(spark, spark.createDataFrame([], SCHEMA)).count() == 0
