"""Searches of the catalogue: criteria, index columns, aliases, TF-IDF, and vehicles mined from texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import values as V

#: Rows whose terms a task holds.
TASK = 20_000


def find(entries: DataFrame, criteria: dict) -> DataFrame:
    """Entries by brand_prefix, year_range (inclusive), model_contains, else equality of a column (texts in any case); other keys are ignored."""
    for key, value in criteria.items():
        if key == "brand_prefix":
            entries = entries.where(F.upper("brand").startswith(value.upper()))
        elif key == "year_range":
            entries = entries.where(F.col("year").between(*value))
        elif key == "model_contains":
            entries = entries.where(F.upper("model").contains(value.upper()))
        elif key in entries.columns:
            entries = entries.where(F.upper(key) == value.upper() if isinstance(value, str) else F.col(key) == value)
    return entries


def index(brand: Column, model: Column, year: Column, description: Column, kind: Column) -> dict[str, Column]:
    """search_text, brand_year, n_tokens and embed_text of an entry."""
    tokens = F.array_distinct(F.filter(F.split(F.upper(F.concat_ws(" ", brand, model, kind)), " "), lambda w: (F.length(w) > 1) & w.rlike("^[A-Z0-9]+$")))
    return {
        "search_text": F.upper(F.concat_ws(" ", brand, model, description)), "brand_year": F.concat(brand, F.lit("_"), year.cast("string")), "n_tokens": F.size(tokens).cast("long"),
        "embed_text": F.lower(F.concat_ws(" ", brand, model, year.cast("string"), F.lit("tipo"), kind)),
    }


def with_aliases(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """Adds canonical (the column itself where it is no alias) and aliases, the sorted aliases of the canonical name. The alias table
    (alias, canonical) is small configuration: it is broadcast."""
    all_of = aliases.groupBy("canonical").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    own = aliases.join(all_of, "canonical").select(F.upper("alias").alias("_key"), F.col("canonical").alias("_name"), F.col("aliases").alias("_all"))
    out = df.withColumn("_key", F.upper(column)).join(F.broadcast(own), "_key", "left")
    return out.withColumns({"canonical": F.coalesce("_name", column), "aliases": F.coalesce("_all", F.array().cast("array<string>"))}).drop("_key", "_name", "_all")


def tfidf(df: DataFrame, key: str, text: str, terms: int = 1000) -> DataFrame:
    """(key, t, x): TF-IDF weights, tf * (ln((1 + n) / (1 + df)) + 1), of each row's terms by unit length. Terms are the words of two characters
    or more and the pairs of neighbours among them; the `terms` most frequent of the table count, of equal ones the first by name.
    Rows of terms repeat so much that they look small when packed: joins of them are told to sort, not to send one side to the driver."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_]", " "), r"\s+", " ")), " "), lambda w: F.length(w) > 1)
    n = df.count()
    w = df.select(key, text).repartition(n // TASK + 1, key).select(key, words.alias("_w"))  # once by key: what follows by key and term needs no more
    two = F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.concat_ws(" ", F.element_at("_w", i), F.element_at("_w", i + 1)))
    every = w.select(key, F.explode(F.concat("_w", F.when(F.size("_w") > 1, two).otherwise(F.array().cast("array<string>")))).alias("t"))
    f = every.groupBy(key, "t").agg(F.count(F.lit(1)).alias("tf"))
    d = f.groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("all")).orderBy(F.desc("all"), "t").limit(terms).drop("all")
    x = f.join(F.broadcast(d), "t").select(key, "t", (F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("x"))  # `terms` rows
    length = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l"))
    return x.join(length.hint("merge"), key).select(key, "t", (F.col("x") / F.col("l")).alias("x"))


def tfidf_cosine(x: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """similarity of the pairs (left, right) of rows that share a word."""
    a = pairs.join(x.hint("merge"), left)
    b = x.select(F.col(left).alias(right), "t", F.col("x").alias("y"))
    return a.join(b.hint("merge"), [right, "t"]).groupBy(left, right).agg(F.sum(F.col("x") * F.col("y")).alias("similarity"))


def vehicle_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, vehicle, position): lines of ten characters or more that look like vehicles, cleaned, each once in order of first place."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    found = lines.where((F.length("line") >= 10) & V.vehicle_line(F.col("line"))).select(key, "at", V.clean_vehicle(F.col("line")).alias("vehicle")).where("vehicle <> ''")
    once = found.groupBy(key, "vehicle").agg(F.min("at").alias("at"))
    return once.select(key, "vehicle", F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("position"))
