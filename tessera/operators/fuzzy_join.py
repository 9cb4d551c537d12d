"""Joins by fuzzy equality of short texts: Indel similarity and containment, without comparing every pair.

Indel similarity of a and b is 2c / (la + lb), with c the length of the longest common subsequence. For a similarity of at least t:

* Length. c is at most the shorter length, so the longer one is at most (2 - t) / t of the shorter.
* Grams. Of the la + 1 pairs of adjacent letters of ^a$, a letter that b lacks breaks two and a letter that b has besides breaks one, so both
  have at least 3c - la - lb + 1 pairs in common, counted with repeats. So in a fixed order of all pairs, rarest first, they
  share one among the first (la + 1) - (that least number) + 1 of each (prefix filter).

Texts meet by such a pair of letters, within their block and near lengths; the few that do are settled by the exact ratio, and
those where one contains the other are added. Everything runs on distinct texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fuzzy import indel_ratio
from tessera.operators.contains import contains_join


def _least_common(la: Column, percent: int) -> Column:
    """The least number of pairs that a text of that length has in common with any that is similar to it: with the shortest such text."""
    shortest = F.ceil(la * percent / (200 - percent))
    return F.ceil((3 * percent - 200) * (la + shortest) / 200 + 1)


def _prefixes(texts: DataFrame, counts: DataFrame, by: list[str], percent: int) -> DataFrame:
    """(by, id, len, gram) of the first pairs of each text."""
    grams = _grams(texts, by).join(counts, [*by, "gram"])
    w = Window.partitionBy("id", *by).orderBy("often", "gram")
    return grams.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("len") + 2 - _least_common(F.col("len"), percent)).select(*by, "id", "len", "gram")


def _grams(texts: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, len, gram): the pairs of adjacent letters of each text, repeats told apart by a number."""
    padded = F.concat(F.lit("\x02"), F.col("text"), F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    some = texts.select(*by, "id", F.length("text").alias("len"), F.explode(pairs).alias("pair"))
    n = some.groupBy(*by, "id", "len", "pair").agg(F.count(F.lit(1)).alias("n"))
    return n.select(*by, "id", "len", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(F.col("pair").alias("pair"), i.alias("nth")))).alias("gram"))


def similar_pairs(left: DataFrame, a: str, right: DataFrame, b: str, by: tuple[str, ...] = (), percent: int = 80) -> DataFrame:
    """(by, a, b, ratio) of the distinct texts of equal `by` whose Indel similarity is at least percent, which lies from 67 to 99; null
    and empty texts have none."""
    if not 67 <= percent <= 99:
        raise ValueError("pairs of letters tell nothing apart at that similarity")
    key = list(by)
    one = left.where(F.col(a) != "").select(*key, F.col(a).alias("text")).distinct().withColumn("id", F.xxhash64("text"))
    other = right.where(F.col(b) != "").select(*key, F.col(b).alias("text")).distinct().withColumn("id", F.xxhash64("text"))
    counts = _grams(one.unionByName(other), key).groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("often"))
    longest = (200 - percent) / percent
    step = lambda n: F.floor(F.log(n) / F.log(F.lit(longest)) + 1e-9)  # noqa: E731  lengths that may meet are at most a step apart
    x = _prefixes(one, counts, key, percent).withColumn("step", step(F.col("len"))).withColumnsRenamed({"id": "ia", "len": "la"})
    y = _prefixes(other, counts, key, percent).withColumn("step", F.explode(F.array(*(step(F.col("len")) + d for d in (-1, 0, 1))))).withColumnsRenamed({"id": "ib", "len": "lb"})
    near = x.join(y, [*key, "gram", "step"]).where(percent * F.greatest("la", "lb") <= (200 - percent) * F.least("la", "lb")).select(*key, "ia", "ib").distinct()
    met = near.join(one.select(*key, F.col("id").alias("ia"), F.col("text").alias(a)), [*key, "ia"]).join(other.select(*key, F.col("id").alias("ib"), F.col("text").alias(b)), [*key, "ib"])
    return met.select(*key, a, b, indel_ratio(F.col(a), F.col(b)).alias("ratio")).where(F.col("ratio") * 100 >= percent - 1e-9)


def fuzzy_models(left: DataFrame, a: str, right: DataFrame, b: str, by: tuple[str, ...] = (), percent: int = 80) -> DataFrame:
    """(by, a, b, similarity) of the distinct models, upper-cased and trimmed: 1 for equal ones, at least 0.9 where one contains the
    other, else their Indel similarity, if it is at least percent. Null and empty models match nothing."""
    key = list(by)
    clean = lambda df, c: df.select(*key, F.upper(F.trim(c)).alias(c)).where(F.col(c) != "").distinct()
    x, y = clean(left, a), clean(right, b)
    alike = similar_pairs(x, a, y, b, by, percent)
    inside = contains_join(y, b, x, a, by).unionByName(contains_join(x, a, y, b, by)).select(*key, a, b).distinct()
    met = alike.join(inside.withColumn("_in", F.lit(True)), [*key, a, b], "full")
    ratio = F.coalesce("ratio", F.lit(0.0))  # a pair that only one contains is less alike than percent, and so below 0.9
    return met.select(*key, a, b, F.when(F.col(a) == F.col(b), 1.0).when(F.col("_in"), F.greatest(ratio, F.lit(0.9))).otherwise(ratio).alias("similarity"))
