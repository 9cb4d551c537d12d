"""Searches by contained text: which texts hold which needles, without comparing every pair.

A text that holds a needle holds all its grams of one length, so a needle meets only texts with its rarest gram. The length is the
longest of GRAMS that the needle has, so that a gram tells nearly as much as the needle; `contains` then settles each pair, so the
result is exact. Searches run on distinct needles and texts, of which only those that can be among the k best go on. What grows
with the input is joined by sorting: Spark would take some of it for small enough to send through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.matching import top_k

GRAMS = (1, 2, 3, 6, 12, 24, 48)


def _grams(c: Column, n: Column) -> Column:
    """Hashes of the grams of n letters, for texts of n letters or more."""
    return F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.xxhash64(F.substring(c, i, n)))


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, needle, text), each pair once, where the text contains the needle and both have equal values of the columns `by`. Null and
    empty needles hold nowhere. Gram rows carry hashes of gram and text; a pair is settled on the texts, so equal hashes do no harm."""
    wanted = needles.where(F.col(needle) != "").select(*by, needle).distinct()
    size = F.greatest(*(F.when(F.length(needle) >= n, n) for n in GRAMS))
    sizes = wanted.agg(F.collect_set(size).alias("_sizes"))  # one row of some of GRAMS
    asked = wanted.select(*by, needle, F.explode(F.array_distinct(_grams(F.col(needle), size))).alias("_gram"))
    held = texts.where(F.col(text) != "").select(*by, text).distinct().withColumn("_text_id", F.xxhash64(text))
    own = F.flatten(F.transform(F.filter("_sizes", lambda n: n <= F.length(text)), lambda n: _grams(F.col(text), n)))
    grams = held.crossJoin(F.broadcast(sizes)).select(*by, "_text_id", F.explode(F.array_distinct(own)).alias("_gram"))
    counts = grams.groupBy(*by, "_gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = asked.join(counts.hint("merge"), [*by, "_gram"]).groupBy(*by, needle).agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    met = rarest.join(grams.hint("merge"), [*by, "_gram"]).select(*by, needle, "_text_id")
    return met.join(held.hint("merge"), [*by, "_text_id"]).where(F.col(text).contains(F.col(needle))).select(*by, needle, text)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def text_search(queries: DataFrame, query: str, phrase: str, entries: DataFrame, code: str, text: str, k: int = 100) -> DataFrame:
    """(query, code, score, rank): the k best entries of each query. An entry scores one for each term of the query that it contains,
    also within a word, and as much again for the whole phrase; in any case of letters, ties by code. An entry without a
    term is none of the k. Terms meet the distinct words of the entries, then the entries of these words."""
    q = queries.select(query, F.upper(phrase).alias("_phrase"))
    phrases = q.select("_phrase").distinct()
    asked = phrases.select("_phrase", F.explode(_words(F.col("_phrase"))).alias("_term")).groupBy("_phrase", "_term").agg(F.count(F.lit(1)).alias("_times"))
    e = entries.select(code, F.upper(text).alias("_text"))
    texts = e.groupBy("_text").agg(F.min(code).alias("_least"))
    words = texts.select("_text", F.explode(F.array_distinct(_words(F.col("_text")))).alias("_word"))
    met = contains_join(words, "_word", asked, "_term")
    holding = words.join(met, "_word").select("_text", "_term").distinct()
    found = asked.join(holding, "_term").groupBy("_phrase", "_text").agg(F.sum("_times").alias("_found"))
    total = F.size(_words(F.col("_phrase"))).cast("long")
    whole = (F.col("_found") == total) & F.col("_text").contains(F.col("_phrase"))
    scored = found.select("_phrase", "_text", (F.col("_found") + F.when(whole, total).otherwise(0)).alias("score"))
    best = top_k(scored.join(texts.hint("merge"), "_text"), "_phrase", [F.desc("score"), F.col("_least")], k).drop("rank", "_least")
    return q.join(_codes_of(best, e, code, "_phrase", [F.desc("score"), F.col(code)], k).hint("merge"), "_phrase").select(query, code, "score", "rank")


def _codes_of(found: DataFrame, entries: DataFrame, code: str, query: str, order: list[Column], k: int) -> DataFrame:
    """The k first codes of each query over the texts found; a text has no more than its k least codes among them. If `found` holds each
    query's k first texts by the least code of a text, these are the k first of all."""
    own = top_k(entries, "_text", [F.col(code)], k).drop("rank")
    return top_k(found.join(own.hint("merge"), "_text").drop("_text"), query, order, k)


def description_search(queries: DataFrame, query: str, description: str, entries: DataFrame, code: str, text: str, k: int = 20, first: int = 50) -> DataFrame:
    """(query, code, rank): the k least codes of entries whose text contains the first characters of the query's description, in any case."""
    q = queries.select(query, F.lower(F.substring(description, 1, first)).alias("_needle"))
    e = entries.select(code, F.lower(text).alias("_text"))
    found = contains_join(e, "_text", q, "_needle")
    return q.join(_codes_of(found, e, code, "_needle", [F.col(code)], k).hint("merge"), "_needle").select(query, code, "rank")
