"""Exact dedup by a stateful stream: keyed state on disk, without expiry, and a check of the full bytes on every hit.

Each text is folded (A-Z only) and digested where it lies; the digests go through a Structured Streaming query whose
state, kept by RocksDB and checkpointed to the shared folder, holds for every digest ever seen the stable identifier
(the largest doc_id), the content locator (the file that holds that row) and the number of rows. There is no watermark,
so nothing expires. Rows are combined before the shuffle, so a group that holds a third of all rows costs one row a task.

A digest that was seen more than once is a hit: the texts of all its rows are compared in full by grouping on the bytes
themselves (again combined first). Texts that share a digest and differ are taken apart into groups of their own.

Defined cases: a null text is an empty text; empty texts are equal to each other; an empty table gives no rows; a
repeated row (same doc_id and text) counts in group_size and gives its row again; a null doc_id never stays unless all of
its group are null; other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, pieces, release, scratch, texts, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition's files take megabytes in advance
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _folder(digest_bytes: int, with_text: bool):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (p for batch in batches for p in pieces(batch, "text")):
            folded = [x.encode().lower() for x in b.column("text").to_pylist()]  # bytes.lower() changes A-Z alone
            digest = [hashlib.sha256(x).digest() for x in folded]
            cols = {"doc_id": b.column("doc_id"), "digest": pa.array([d[:digest_bytes] for d in digest], pa.binary()), "sha256": pa.array([d.hex() for d in digest])}
            if with_text:
                cols |= {"folded": pa.array(folded, pa.binary())}
            else:
                cols |= {"locator": b.column("locator")}
            yield pa.RecordBatch.from_pydict(cols)

    return fold


def digests(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """(doc_id, digest, sha256, locator) of each row; the locator is the file that holds the row, where it lies in one."""
    return texts(docs).withColumn("locator", F.input_file_name()).mapInArrow(_folder(digest_bytes, False), "doc_id long, digest binary, sha256 string, locator string")


def keyed_state(staged_path: str, spark: SparkSession, schema) -> DataFrame:
    """Runs the digests through the stream and returns its state: digest, keep_id, locator, group_size."""
    out, checkpoint = scratch(spark, "dedup-state"), scratch(spark, "dedup-stream")
    columns = "digest binary, keep_id long, locator string, group_size long, batch long"
    spark.createDataFrame([], columns).write.parquet(out)

    def emit(df: DataFrame, batch: int) -> None:
        df.select("digest", "best.keep_id", "best.locator", "group_size", F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(out)

    with settings(spark, STATE):
        seen = spark.readStream.schema(schema).parquet(staged_path).groupBy("digest").agg(F.max(F.struct(F.col("doc_id").alias("keep_id"), "locator")).alias("best"), F.count(F.lit(1)).alias("group_size"))
        query = seen.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(emit).start()
        query.awaitTermination()
    rows = spark.read.schema(columns).parquet(out)  # a digest has a row for each batch that changed it; a batch that ran twice wrote equal rows
    return rows.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "locator", "group_size")).alias("s")).select("digest", "s.keep_id", "s.locator", "s.group_size")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that stays)."""
    spark = docs.sparkSession
    path = scratch(spark, "dedup-digests")
    staged = digests(docs, digest_bytes)
    staged.write.parquet(path)
    rows = spark.read.schema(staged.schema).parquet(path)
    state = written(keyed_state(path, spark, staged.schema), "dedup-keys")

    hits = state.where("group_size > 1").select("digest")
    if digest_bytes >= 32:  # the full bytes of the hits, combined by the bytes before they are shuffled
        again = only(texts(docs).mapInArrow(_folder(digest_bytes, True), "doc_id long, digest binary, sha256 string, folded binary"), hits, "digest")
    else:  # short digests are for tests of the collision path
        again = texts(docs).mapInArrow(_folder(digest_bytes, True), "doc_id long, digest binary, sha256 string, folded binary").join(hits, "digest", "left_semi")
    checked = again.groupBy("digest", "folded").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max("sha256").alias("sha256"))
    checked = written(checked.select("digest", "sha256", "keep_id", "group_size"), "dedup-checked")
    mixed = checked.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    apart = checked.join(mixed, "digest", "left_semi").select("digest", "sha256", F.col("keep_id").alias("own_id"), F.col("group_size").alias("own_size"))

    single = state.where("group_size = 1").select("digest", "keep_id", "locator", "group_size")
    grouped = state.where("group_size > 1").select("digest", "keep_id", "locator", "group_size")
    found = rows.select("doc_id", "digest", "sha256").join(grouped.unionByName(single), "digest")
    found = found.join(apart, ["digest", "sha256"], "left") if mixed.head(1) else found.withColumns({"own_id": F.lit(None).cast("long"), "own_size": F.lit(None).cast("long")})
    keep = F.when(F.col("own_size").isNotNull(), F.col("own_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("own_size", "group_size").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha256").alias("text_sha256"), "locator"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("locator")


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)
"""
