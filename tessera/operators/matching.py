"""Candidate generation, scoring, ranking and decisions for records against a catalogue.

Candidates come from an equi-join on a block key, never from a cross join; a ladder of relaxations is one join with a tier
for each pair and a window that keeps the lowest tier of each query; top-k is a row_number filter, which Spark turns into
a group limit before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


@dataclass(frozen=True)
class Thresholds:
    accept: float = 0.9
    review: float = 0.7


def decide(score: Column, t: Thresholds = Thresholds()) -> Column:
    """auto_accept, needs_review or no_match; bounds are inclusive below."""
    return F.when(score >= t.accept, "auto_accept").when(score >= t.review, "needs_review").otherwise("no_match")


def queue_score(q_brand: Column, brand: Column, q_model: Column, model: Column, q_year: Column, year: Column) -> Column:
    """0.4 brand + 0.4 model (equal 1, inside 0.8, else Jaccard) + 0.2 for the same year."""
    return 0.4 * T.similarity(q_brand, brand, 0.8) + 0.4 * T.similarity(q_model, model, 0.8) + F.when(q_year == year, 0.2).otherwise(0.0)


def year_closeness(a: Column, b: Column) -> Column:
    gap = F.abs(a - b)
    return F.when(gap.isNull(), 0.0).when(gap == 0, 1.0).when(gap == 1, 0.9).when(gap == 2, 0.7).when(gap <= 5, 0.5).otherwise(0.1)


def domain_scores(q_brand: Column, brand: Column, q_model: Column, model: Column, q_year: Column, year: Column) -> tuple[Column, Column, Column]:
    """Brand (inside 0.9, else at most 0.8 of 1.2 Jaccard), model (inside 0.9, else Jaccard) and year components."""
    return T.similarity(q_brand, brand, 0.9, 1.2, 0.8), T.similarity(q_model, model, 0.9), year_closeness(q_year, year)


def lowest_tier(pairs: DataFrame, query: str, tier: Column) -> DataFrame:
    """The pairs of each query's best tier (1 is best; a null tier is no candidate)."""
    w = Window.partitionBy(query)
    return pairs.withColumn("tier", tier).where("tier is not null").withColumn("best", F.min("tier").over(w)).where("tier = best").drop("best")


def top_k(pairs: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("rank") <= k)


def tie_flags(pairs: DataFrame, query: str, score: str, weight: str, within: float = 0.05) -> DataFrame:
    """best, gap to the runner-up and number of candidates within `within` of the best, for each query. A row stands for
    `weight` candidates; candidates are summed by score first, so a query's list is as long as its different scores."""
    by_score = pairs.groupBy(query, score).agg(F.sum(weight).alias("n"))
    found = by_score.groupBy(query).agg(F.reverse(F.array_sort(F.collect_list(F.struct(F.col(score).alias("s"), "n")))).alias("own"))
    best, second = F.col("own")[0]["s"], F.get("own", 1)["s"]
    tied = F.aggregate(F.filter("own", lambda x: x["s"] >= best - within), F.lit(0).cast("long"), lambda t, x: t + x["n"])
    return found.select(query, best.alias("best"), F.when(F.col("own")[0]["n"] > 1, 0.0).otherwise(best - second).alias("gap"), tied.alias("tied"))


def break_ties(candidates: DataFrame, query: str, within: float = 0.05) -> DataFrame:
    """query, tied, code, used from candidates (code, score, y, qy, full, strength, detail): of those within `within` of the best
    the one of the record's year if it is alone, the fullest by 0.2, the newest if it is alone, the one with the strongest
    components above 1.5, the most detailed by a fifth, else the first. All by aggregates of the tie set, without a sort of it."""
    best = F.max("score").over(Window.partitionBy(query))
    t = candidates.withColumn("best", best).where(F.round(F.col("best") - F.col("score"), 6) <= within)
    order = [-F.col("score"), F.col("code")]
    top = lambda c: F.min_by("code", F.struct((-F.col(c)).alias("v"), *(o.alias(f"o{i}") for i, o in enumerate(order))))
    two = lambda c: F.slice(F.sort_array(F.collect_list(c), asc=False), 1, 2)
    exact = F.col("y") == F.col("qy")
    g = t.groupBy(query).agg(
        F.count(F.lit(1)).alias("tied"), F.min_by("code", F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("first"), F.count_if(exact).alias("exact"), F.min(F.when(exact, F.col("code"))).alias("exact_code"),
        *(two(c).alias(f"{c}s") for c in ("full", "y", "detail")), F.max("strength").alias("strongest"), *(top(c).alias(f"{c}_code") for c in ("full", "y", "strength", "detail")),
    )
    best_of, second = (lambda c: F.get(f"{c}s", 0)), (lambda c: F.get(f"{c}s", 1))  # null where no candidate has one
    code = (
        F.when(F.col("tied") == 1, F.col("first")).when(F.col("exact") == 1, F.col("exact_code")).when(F.round(best_of("full") - second("full"), 6) >= 0.2, F.col("full_code"))
        .when(best_of("y").isNotNull() & (second("y").isNull() | (second("y") < best_of("y"))), F.col("y_code")).when(F.col("strongest") > 1.5, F.col("strength_code"))
        .when(best_of("detail") > second("detail") * 1.2, F.col("detail_code")).otherwise(F.col("first"))
    )
    return g.select(query, "tied", code.alias("code"), (F.col("tied") > 1).alias("used"))
