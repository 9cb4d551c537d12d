"""Stages as Structured Streaming queries: each reads the messages of the one before it, works, and writes those of the next.

Delivery is at least once with an idempotent sink: a batch's files are named by its number, and a batch that runs again replaces
them, so nothing is done twice. A message that fails stays in its stage's output as FAILED and goes no further.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def run(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stage over all that is new in source, and returns its whole output."""

    def emit(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    there = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(schema)
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(there).isFile():  # a stream reads folders
        reader, source = reader.option("pathGlobFilter", there.getName()), there.getParent().toString()
    messages = reader.parquet(source)
    work(messages).writeStream.foreachBatch(emit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], work(spark.createDataFrame([], schema)).schema)
    return spark.read.parquet(out).drop("batch")


def status(failed: Column, done: str) -> Column:
    return F.when(failed, "FAILED").otherwise(done)


def chain(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """event_id, user_id, failed, status, stages of every message after extract, transform and export."""
    schema = spark.read.parquet(source).schema
    extracted = run(spark, source, schema, f"{folder}/extract", f"{folder}/extract-checkpoint", lambda m: m.select("event_id", "user_id", F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("failed"), F.lit(1).alias("stages")))
    going = lambda m: m.where(~F.col("failed")).withColumn("stages", F.col("stages") + 1)
    transformed = run(spark, f"{folder}/extract", extracted.schema, f"{folder}/transform", f"{folder}/transform-checkpoint", going)
    exported = run(spark, f"{folder}/transform", transformed.schema, f"{folder}/export", f"{folder}/export-checkpoint", going)
    out = exported.unionByName(extracted.where("failed"))
    return out.withColumn("status", status(F.col("failed"), "EXPORTED")).select("event_id", "user_id", "failed", "status", "stages")
