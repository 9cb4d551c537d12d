"""Queries of the vector index and of filtered neighbours, with SQL where the result doesn't depend on learned cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import vectors as X
from tessera.plans.contract import register, table
from tessera.sources.files import work_dir


@register()
def ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by the partitioned index, for every vector whose id is divisible by 20, among all vectors."""
    v = table(spark, sf_dir, "embeddings")
    path = work_dir(spark)
    X.build_index(v, path)
    return X.search_index(spark, path, v.where("vec_id % 20 = 0"), 10, probes=16)


@register("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label::VARCHAR AS brand, 1990 + vec_id % 30 AS year, CASE WHEN vec_id % 7 <> 0 THEN ['sedan', 'suv'][vec_id % 2 + 1] END AS body FROM embeddings),
q AS (SELECT vec_id AS query_id, e, CASE WHEN vec_id % 3 <> 0 THEN brand END AS brand, CASE WHEN vec_id % 4 <> 0 THEN year - 4 END AS lo, CASE WHEN vec_id % 5 <> 0 THEN year + 6 END AS hi, CASE WHEN vec_id % 40 = 0 THEN 'suv' END AS body FROM v WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM q JOIN v ON query_id <> vec_id AND (q.brand IS NULL OR q.brand = v.brand) AND (lo IS NULL OR v.year >= lo) AND (hi IS NULL OR v.year <= hi) AND (q.body IS NULL OR q.body = v.body)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10
""")
def vector_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the brand, body and range of years that a query asks for, where it asks."""
    k = F.col("vec_id")
    body = F.when(k % 7 != 0, F.element_at(F.array(F.lit("sedan"), F.lit("suv")), (k % 2 + 1).cast("int")))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("brand"), (1990 + k % 30).alias("year"), body.alias("body"))
    asked = v.where("vec_id % 20 = 0").select(
        "vec_id", "embedding", F.when(k % 3 != 0, F.col("brand")).alias("brand"), F.when(k % 4 != 0, F.col("year") - 4).alias("year_min"), F.when(k % 5 != 0, F.col("year") + 6).alias("year_max"), F.when(k % 40 == 0, "suv").alias("body")
    )
    return X.knn(v, asked, 10, same=("brand", "body"), within="year").withColumn("rank", F.col("rank").cast("long"))
