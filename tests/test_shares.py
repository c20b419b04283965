import duckdb
import pytest
from pyspark.sql import functions as F

from spanwarden.operators import evaluation
from spanwarden.plans import queries as plans

SECRET = "token=Qa7xP2mN9vL4sT8rY1uI6oE3wA5dF0gH"


def share(spark, tmp_path, name, hits, expected):
    """The rows of a query and of its SQL for documents of which so many expect a secret and so many have one."""
    n = F.col("id")
    docs = spark.range(expected).select((2 * n + 1).alias("doc_id"), F.concat(F.lit("1234567890123456 "), F.when(n < hits, SECRET).otherwise("none")).alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(plans.oracle_sql()[name])
    got = plans.queries()[name](spark, str(tmp_path)).select(*want.columns)
    return sorted(tuple(r) for r in got.collect()), sorted(want.fetchall())


@pytest.mark.parametrize(("hits", "expected"), [(1, 16), (5, 16), (9, 80), (3, 16)])
def test_halves_in_the_report_are_as_the_sql_has_them(spark, tmp_path, hits, expected):
    got, want = share(spark, tmp_path, "eval_report", hits, expected)
    assert got == want and len(got) == 1


@pytest.mark.parametrize(("hits", "expected"), [(41, 640), (1, 3)])
def test_shares_are_rounded_as_in_the_sql(spark, tmp_path, hits, expected):
    got, want = share(spark, tmp_path, "eval_metrics", hits, expected)
    assert got == want and len(got) == 1


def test_percent_is_that_of_the_exact_value(spark):
    shares = [k / n for n in (7, 16, 80, 400, 1000, 2000) for k in range(n + 1)]
    rows = spark.createDataFrame([(x,) for x in [*shares, None, float("nan")]], "x double").select("x", evaluation.percent(F.col("x")).alias("p")).collect()
    assert [r.p for r in rows] == [f"{x * 100:5.1f}%" for x in shares] + ["  N/A"] * 2
