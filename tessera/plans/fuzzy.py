"""Queries of fuzzy joins and their SQL; the longest common subsequence in SQL is a fold over bits of whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.fuzzy_join import fuzzy_models
from tessera.plans.contract import DIRTY_SQL, catalogue, dirty, register, table


def lcs_sql(a: str, b: str) -> str:
    """Length of the longest common subsequence of two texts, the first of at most 60 letters."""
    full = f"((1::BIGINT << len({a})) - 1)"
    mask = f"list_sum(list_transform(range(len({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = substr({b}, j, 1) THEN 1::BIGINT << i ELSE 0 END))::BIGINT"
    return f"(len({a}) - bit_count(list_reduce(list_prepend({full}, list_transform(range(1, len({b}) + 1), lambda j: {mask})), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def ratio_sql(a: str, b: str) -> str:
    return f"(2.0::DOUBLE * {lcs_sql(a, b)} / (len({a}) + len({b})))"


@register(f"""
WITH {DIRTY_SQL},
x AS (SELECT DISTINCT upper(trim(q_brand)) AS b, upper(trim(q_model)) AS q_model FROM q WHERE q_model <> ''), y AS (SELECT DISTINCT upper(trim(brand)) AS b, upper(trim(model)) AS model FROM c),
p AS (SELECT b, q_model, model, {ratio_sql("q_model", "model")} AS r FROM x JOIN y USING (b)),
s AS (SELECT b, q_model, model, CASE WHEN q_model = model THEN 1.0 WHEN contains(q_model, model) OR contains(model, q_model) THEN greatest(r, 0.9) ELSE r END AS s FROM p)
SELECT b AS brand, q_model, model, round(s, 6) AS similarity FROM s WHERE s >= 0.8
""")
def fuzzy_model_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's models of a record's brand that are like the record's model."""
    parts = table(spark, sf_dir, "part")
    brand = lambda c: F.upper(F.trim(c)).alias("brand")
    out = fuzzy_models(dirty(parts).select(brand("q_brand"), "q_model"), "q_model", catalogue(parts).select(brand("brand"), "model"), "model", by=("brand",))
    return out.withColumn("similarity", F.round("similarity", 6))
