import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanwarden.llm import packing, quality
from spanwarden.llm.queries import tokenizer_file

from ..conftest import DATA
from .test_mixing import water
from .test_near_dedup import brute as near_brute
from .test_packing import brute_pieces, gapless

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents of sf0.001 and what every stage made of them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    assert all(d.dtypes == stages[0].dtypes for d in stages[1:-1])


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {d for d, _ in pairs(stages[1])}
    model = quality.fit(spark, stages[0], labels)
    assert kept == {r.doc_id for r in quality.score(spark, stages[0], model).filter("predicted = 1").collect()}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    assert all(d in kept for d, q in marks.items() if q == 1) and not any(d in kept for d, q in marks.items() if q == 0)


def test_exact(stages):
    first = {}
    for d, t in sorted(pairs(stages[1])):
        first.setdefault(" ".join((t or "").split()), d)
    assert sorted(d for d, _ in pairs(stages[2])) == sorted(first.values())


def test_near(stages):
    rows = pairs(stages[2])
    assert {d for d, _ in pairs(stages[3])} == {d for d, _, c in near_brute(rows) if d == c}


def test_mix(stages):
    rows = stages[3].select("doc_id", "text", "source").collect()
    sizes, source, words = {}, {}, {}
    for r in rows:
        source[r.doc_id], words[r.doc_id] = r.source, (r.text or "").split()
        sizes[r.source] = sizes.get(r.source, 0) + len(words[r.doc_id])
    taken, per = {}, {}
    for d, t in pairs(stages[4]):
        part = t.split()
        at = 0
        for w in part:  # in order, from the document
            at = words[d].index(w, at) + 1
        taken[source[d]] = taken.get(source[d], 0) + len(part)
        per[d] = per.get(d, 0) + len(part)
    assert taken == {s: int(x + 1e-9) for s, x in water(sizes).items()}
    assert all(n <= 2 * len(words[d]) for d, n in per.items())


def test_pack(stages):
    rows = stages[5].collect()
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted(brute_pieces(pairs(stages[4])))
    assert gapless(rows) <= math.ceil(sum(r.length for r in rows) / packing.CAPACITY) + 1


def test_run_gives_the_last_stage(spark, stages):
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1])
    assert tokenizer_file().endswith("word_bpe_49k.json")


def test_null_ids_empty_texts_and_names_that_clash(spark, tmp_path):
    """Rows without ids, texts or sources, repeated rows, and columns named like those of the plans."""
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, "no id " * 30, None), (None, "no id " * 30, None), (7, None, "src1"), (7, "", "src1"), (9, " \n", None)], "doc_id long, text string, source string")
    docs = given.unionByName(odd, allowMissingColumns=True)
    for name in ("row", "h", "part", "digest", "locator", "id", "label", "score", "salt", "n"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    out = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, out, str(tmp_path))
        assert after.columns == docs.columns, name
        path = str(tmp_path / name.replace(" ", "-"))
        after.write.parquet(path)
        out = spark.read.parquet(path)
    assert out.count() and gapless(corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect())


def test_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
