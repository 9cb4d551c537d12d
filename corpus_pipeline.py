"""A corpus pipeline of five stages over documents; each works on all that its predecessor kept.

toxicity: documents that the scores reject go. exact_dedup: of equal texts (A-Z folded) the row with the largest doc_id
stays. jaccard_join: of each group of near duplicates (word shingles of five, similarity 0.8) the smallest doc_id stays.
decontamination: documents that hold a benchmark item go. bpe: the rest as token ids.

A null doc_id names no document to drop, so such rows are kept by every stage; other cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, exact_dedup, jaccard_join, toxicity
from tessera.llm.common import without, written

#: SQL cannot express the learned toxicity model nor the vocabulary's merges; tests/llm holds a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.fold(5, 0))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(docs)
    gone = written(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "pipeline-copies")
    return without(docs, gone, "doc_id")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_components(docs, k=5, percent=80)
    gone = written(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "pipeline-near-copies")
    return without(docs, gone, "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("decontamination", drop_contaminated), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
