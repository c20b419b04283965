"""Exact deduplication as a stateful stream.

Arrivals pass through a streaming aggregation whose keyed state lives in RocksDB on disk, has no
watermark and so never expires. For each content digest the state keeps the first stable identifier,
its place of arrival (ingest and row number), the locator of its content (a hash of the raw text) and
the number of arrivals. Partial aggregation runs before the shuffle, so a group that holds a third of
all rows costs one state row per task.

A digest hit is a claim, not a proof: the texts of all rows in groups of two or more are fetched by
their locator (dealt over ``SALTS`` parts, so a large group spreads over tasks) and grouped by digest
and whole bytes. A digest that stands for several texts is resolved by the texts themselves. Nothing
but the stored arrivals depends on row numbers, so a source may be recomputed in another order.

Defined cases: a null text is the empty text and all empty texts are equal. Ids may repeat or be
null: the smallest non-null id stays, and of rows with one id and one text exactly one stays. An empty
table gives an empty result. Further columns are carried by ``deduplicate`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import one_space, text_of
from .workspace import Workspace

#: Parts that the rows of one digest or locator are dealt over when they meet their group.
SALTS = 32

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256_digest(body: Column) -> Column:
    return F.unhex(F.sha2(body.cast("binary"), 256))


def normalised(text_col: str = "text") -> Column:
    return one_space(text_of(text_col))


class StreamingDeduplicator:
    """Keyed state over any number of ingests.

    ``state_dir`` keeps arrivals, state and groups between runs; without it they live in a scratch
    folder of this object.
    """

    def __init__(self, spark: SparkSession, state_dir: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[str], Column] = normalised, digest: Callable[[Column], Column] = sha256_digest, max_files_per_trigger: int | None = None):
        self.spark, self.id_col, self.text_col = spark, id_col, text_col
        self.normalise, self.digest, self.max_files = normalise, digest, max_files_per_trigger
        self.ws = Workspace(spark, "exact-dedup", state_dir)
        self.ingests: dict[int, DataFrame] = {}

    def ingest(self, docs: DataFrame, number: int | None = None) -> None:
        """Feeds ``docs`` to the state. Repeating a number replaces an ingest that failed midway."""
        number = len(self.ingests) if number is None else number
        rows = docs.select(F.col(self.id_col).alias("doc_id"), self.digest(self.normalise(self.text_col)).alias("digest"), F.monotonically_increasing_id().alias("row"), self._locator().alias("locator"))
        rows.write.mode("overwrite").parquet(self.ws.path(f"arrivals/ingest={number}"))
        self.ingests[number] = docs
        self._advance(rows)

    def _locator(self) -> Column:
        return F.xxhash64(text_of(self.text_col))

    def _advance(self, rows: DataFrame) -> None:
        """Runs the stream over what has arrived since the last run."""
        spark, kept = self.spark, {k: self.spark.conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        try:
            source = spark.readStream.schema(T.StructType([*rows.schema.fields, T.StructField("ingest", T.IntegerType())])).option("basePath", self.ws.path("arrivals"))
            if self.max_files:
                source = source.option("maxFilesPerTrigger", self.max_files)
            groups = source.parquet(self.ws.path("arrivals/*")).groupBy("digest").agg(F.min(_entry()).alias("first"), F.count(F.lit(1)).alias("n"))
            path = self.ws.path("groups")
            (
                groups.writeStream.outputMode("update")
                .foreachBatch(lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch={batch}"))
                .option("checkpointLocation", self.ws.path("state"))
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
        finally:
            for k, v in kept.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)

    def arrivals(self) -> DataFrame:
        return self.spark.read.option("basePath", self.ws.path("arrivals")).parquet(self.ws.path("arrivals/*"))

    def groups(self) -> DataFrame:
        """The state as of the last batch: digest, first entry and number of arrivals."""
        schema = f"digest binary, first struct<no_id:boolean,doc_id:{self._id_type()},ingest:int,row:bigint,locator:bigint>, n bigint, batch int"
        table = self.spark.read.schema(schema).option("basePath", self.ws.path("groups")).parquet(self.ws.path("groups"))
        batches = [r[0] for r in table.select("batch").distinct().limit(2).collect()]
        if len(batches) < 2:
            return table.drop("batch")
        return table.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s")).select("digest", "s.first", "s.n")

    def _id_type(self) -> str:
        return dict(next(iter(self.ingests.values())).dtypes)[self.id_col]

    def _texts(self) -> DataFrame:
        """doc_id, text, ingest of all arrivals."""
        out = None
        for number, docs in self.ingests.items():
            part = docs.select(F.col(self.id_col).alias("doc_id"), F.col(self.text_col).alias("text"), self._locator().alias("locator"), F.lit(number).alias("ingest"))
            out = part if out is None else out.unionByName(part)
        return out

    def _clashing(self, hits: DataFrame) -> DataFrame:
        """The digests among the hits (locator) that stand for several texts, by whole bytes."""
        wanted = hits.select("locator").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        texts = self._texts().withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        found = texts.join(wanted, ["locator", "salt"], "left_semi").select(self.normalise("text").cast("binary").alias("body"))
        # rows of one text become one within each task, before the shuffle
        bodies = found.groupBy("body").agg(F.count(F.lit(1)).alias("n")).select(self.digest(F.col("body").cast("string")).alias("digest"))
        return bodies.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")

    def decisions(self) -> DataFrame:
        """One row per arrival: doc_id, keep_id, group_size, kept, digest, ingest, row."""
        groups = self.groups().filter("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        arrivals = self.arrivals().withColumn("salt", F.pmod(F.xxhash64("ingest", "row"), F.lit(SALTS)).cast("int"))
        rows = arrivals.join(groups.hint("merge"), ["digest", "salt"], "left").drop("salt")
        clashing = self.ws.save(self._clashing(rows.filter("n > 1")), "clashing")
        alone = F.col("n").isNull()
        kept = alone | ((F.col("first.ingest") == F.col("ingest")) & (F.col("first.row") == F.col("row")))
        columns = ["doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), "digest", "ingest", "row"]
        return rows.select(*columns) if clashing.isEmpty() else self._regrouped(rows, clashing, columns)

    def _regrouped(self, rows: DataFrame, clashing: DataFrame, columns: list) -> DataFrame:
        """Some digests stand for several texts: their rows are read again and grouped by digest and text,
        with numbers of their own in place of the arrivals'."""
        texts = self._texts().select("doc_id", self.normalise("text").alias("body"), "ingest", "locator")
        texts = texts.withColumn("digest", self.digest(F.col("body"))).join(clashing, "digest", "left_semi")
        texts = self.ws.save(texts.withColumn("row", F.monotonically_increasing_id()), "clashing-texts")
        by_text = texts.groupBy("digest", "body").agg(F.min(_entry()).alias("first"), F.count(F.lit(1)).alias("n"))
        by_text = by_text.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        apart = texts.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(by_text, ["digest", "body", "salt"])
        return rows.join(clashing, "digest", "left_anti").select(*columns).unionByName(apart.select(*columns))


def _entry() -> Column:
    """Orders rows of a group: ids before null, then by id, then by place of arrival."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("ingest"), F.col("row"), F.col("locator"))


def exact_decisions(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for one table."""
    dedup = StreamingDeduplicator(spark, **options)
    dedup.ingest(docs)
    return dedup.decisions()


def deduplicate(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    dedup = StreamingDeduplicator(spark, **options)
    dedup.ingest(docs)
    kept = dedup.decisions().filter("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    marked = docs.withColumn("__text_digest", dedup.digest(dedup.normalise(dedup.text_col)))
    joined = marked.join(kept, F.col(dedup.id_col).eqNullSafe(F.col("__id")) & (F.col("__text_digest") == F.col("__digest")), "left_semi")
    return joined.dropDuplicates([dedup.id_col, "__text_digest"]).drop("__text_digest")
