"""Matching of records against a catalogue from candidates to results, on distinct keys.

What a score depends on is scored once: records are reduced to their distinct (brand, model, year, ...), entries to their distinct
(brand, model, year, ...) with a count and their least code, and the similarity of two models is computed for each distinct
pair of them. A record of a year meets the entries of its brand and year; only keys without such entries meet their brand,
and those without a year meet it once for all years. Records join their key's result at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vehicle as H
from tessera.operators import matching as M
from tessera.operators.fuzzy_join import fuzzy_models
from tessera.sources.files import stored

KEY = ["b", "q_model", "q_year"]


def upper(c: str | Column) -> Column:
    return F.upper(F.trim(c))


def keys_of(records: DataFrame, *more: str) -> DataFrame:
    """The distinct (b, q_model, q_year, ...) of the records; records without a brand have none."""
    return records.select(upper("q_brand").alias("b"), "q_model", "q_year", *more).where("b is not null").distinct()


def entries_of(catalogue: DataFrame, *more: str) -> DataFrame:
    """The distinct (b, model, year, ...) of the catalogue with n and the least code."""
    c = catalogue.select(upper("brand").alias("b"), "model", "year", "code", *more)
    return c.groupBy("b", "model", "year", *more).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("code"))


def candidates(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """keys with entries: those of brand and year, by_year true; where there are none those of the brand. A key without a year meets
    the entries of equal model and more of its brand as one, with a null year."""
    by_year = keys.join(entries.withColumn("q_year", F.col("year")), ["b", "q_year"]).withColumn("by_year", F.lit(True))
    rest = keys.join(entries.select("b", F.col("year").alias("q_year")).distinct(), ["b", "q_year"], "left_anti")
    more = [c for c in entries.columns if c not in ("b", "model", "year", "n", "code")]
    every = entries.groupBy("b", "model", *more).agg(F.sum("n").alias("n"), F.min("code").alias("code")).withColumn("year", F.lit(None).cast("int"))
    of_brand = rest.where("q_year is not null").join(entries, "b").unionByName(rest.where("q_year is null").join(every.select(*entries.columns), "b"))
    return by_year.unionByName(of_brand.withColumn("by_year", F.lit(False)).select(*by_year.columns))


def with_model_scores(pairs: DataFrame, keys: DataFrame, entries: DataFrame, **scores: Column) -> DataFrame:
    """The pairs with scores of (q_model, model), each computed once for the two; a null model scores 0."""
    models = keys.select("b", "q_model").distinct().join(entries.select("b", "model").distinct(), "b").select("q_model", "model").distinct()
    scored = models.select("q_model", "model", *(c.alias(n) for n, c in scores.items()))
    return pairs.join(scored, ["q_model", "model"], "left").fillna(0.0, list(scores))


def back(records: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """The records with their key's result; keys are compared with nulls as values."""
    key = [*KEY, *more]
    f = found.withColumnsRenamed({c: f"_{c}" for c in key})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key[1:]]
    joined = records.withColumn("b", upper("q_brand")).join(f, [F.col("b") == F.col("_b"), *on], "left")
    return joined.drop("b", *(f"_{c}" for c in key))


def told(description: Column) -> list[Column]:
    """An entry's class of each attribute that its description tells, `?` where it is of none."""
    out = []
    for name, parts, info in (("fuel", H.FUEL_PARTS, H.FUEL_PARTS), ("drivetrain", H.DRIVETRAIN_PARTS, H.DRIVETRAIN_PARTS), ("body", H.BODY_PARTS, H.BODY_INFO)):
        out.append(F.when(H.holds_any(description, info), F.coalesce(H.first_part_class(description, parts), F.lit("?"))).alias(f"e_{name}"))
    return out


ATTRIBUTES = ("fuel", "drivetrain", "body")


def attribute_score(q: dict[str, Column], e: dict[str, Column]) -> Column:
    """As tessera.functions.vehicle.attribute_score, of classes instead of texts: e is null where nothing is told."""
    total, weight, none = F.lit(0.0), F.lit(0.0), F.lit(True)
    for name in ATTRIBUTES:
        told = q[name].isNotNull() & e[name].isNotNull()
        total += F.when(told & (q[name] == e[name]), H.ATTRIBUTE_WEIGHTS[name]).otherwise(0.0)
        weight += F.when(told, H.ATTRIBUTE_WEIGHTS[name]).otherwise(0.0)
        none &= q[name].isNull()
    return F.when(none, 0.5).when(weight == 0, 0.3).otherwise(total / weight)


def model_pairs(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """(b, q_model, model) of the models that are alike, as they are written, with sm, their similarity."""
    q, e = keys.select("b", "q_model").distinct(), entries.select("b", "model").distinct()
    alike = fuzzy_models(q, "q_model", e, "model", by=("b",)).select("b", F.col("q_model").alias("_q"), F.col("model").alias("_m"))
    met = q.withColumn("_q", upper("q_model")).join(alike, ["b", "_q"]).join(e.withColumn("_m", upper("model")), ["b", "_m"])
    return met.select("b", "q_model", "model", T.similarity(F.col("q_model"), F.col("model"), 0.9).alias("sm"))


def two_largest(c: str | Column) -> Column:
    return F.slice(F.sort_array(c, asc=False), 1, 2)


def least_by(value: str, code: Column | str = "code") -> Column:
    """Aggregate (v, code): the largest value, negated, and the least code that has it; null where no row has a value."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col(code).alias("code"))))


def winner(tied: Column) -> Column:
    """The code of a tie set, by the rules of tessera.operators.matching.break_ties. tied: an array of classes of entries that have one
    score each: score, full, strength, m (how many entries the class stands for), code (the least), exact and exact_code (of the
    record's year), and the two largest years and details (ys, ds) with the largest one's least code (newest, longest)."""
    least = lambda f: F.array_min(F.transform(tied, f))["code"]
    among = lambda c: F.array_min(F.transform(F.filter(tied, lambda x: x[c].isNotNull()), lambda x: F.struct(x[c]["v"].alias("v"), (-x["score"]).alias("s"), x[c]["code"].alias("code"))))["code"]
    by = lambda c: least(lambda x: F.struct((-x[c]).alias("v"), (-x["score"]).alias("s"), x["code"].alias("code")))
    total = lambda c: F.aggregate(tied, F.lit(0).cast("long"), lambda t, x: t + x[c])
    first = least(lambda x: F.struct((-x["score"]).alias("s"), x["code"].alias("code")))
    fulls = two_largest(F.flatten(F.transform(tied, lambda x: F.when(x["m"] > 1, F.array(x["full"], x["full"])).otherwise(F.array(x["full"])))))
    ys, ds = two_largest(F.flatten(F.transform(tied, lambda x: x["ys"]))), two_largest(F.flatten(F.transform(tied, lambda x: x["ds"])))
    one, two = (lambda c: F.get(c, F.lit(0))), (lambda c: F.get(c, F.lit(1)))
    return (
        F.when(total("m") == 1, first).when(total("exact") == 1, F.array_min(F.transform(tied, lambda x: x["exact_code"]))).when(F.round(one(fulls) - two(fulls), 6) >= 0.2, by("full"))
        .when(one(ys).isNotNull() & (two(ys).isNull() | (two(ys) < one(ys))), among("newest")).when(F.array_max(F.transform(tied, lambda x: x["strength"])) > 1.5, by("strength"))
        .when(one(ds) > two(ds) * 1.2, among("longest")).otherwise(first)
    )


def match_records(records: DataFrame, catalogue: DataFrame, error: Column, within: float = 0.05, thresholds: M.Thresholds = M.Thresholds(0.9, 0.7)) -> DataFrame:
    """One row for each record (query_id, q_brand, q_model, q_year, fuel, drivetrain, body) against a catalogue (code, brand, model, year,
    description): status, code, strategy, candidates, score, tied, tie_break, confidence, level, decision, matches, warnings.

    A record with an error (a message, else null) is an ERROR row and a record without candidates a NO_MATCH row. Candidates are
    the entries of brand and year, else of the brand; of these the ones with a similar model, where there are any. The score
    is 0.4 brand, 0.35 model, 0.15 year and 0.1 attributes; ties go through the rules of break_ties; a tie of entries that differ
    in nothing but their code goes to the least code.

    Models and years of records meet those of entries without their attributes and only where the models are alike, if any are;
    pairs whose model and year are too far behind the best for any attributes to make up go. What is left is summed by model and
    year scores and the entry's attributes, so that a key of records meets a few classes and no single entries."""
    records = stored(records.withColumn("_error", error))
    error = F.col("_error")
    told_of = [f"e_{a}" for a in ATTRIBUTES]
    keys = stored(keys_of(records.where(error.isNull()), *ATTRIBUTES))
    entries = stored(entries_of(catalogue.select("code", "brand", "model", "year", F.length("description").alias("detail"), *told(F.col("description"))), "detail", *told_of))
    every = entries.groupBy("b", "model", "detail", *told_of).agg(F.sum("n").alias("n"), F.min("code").alias("code")).withColumn("year", F.lit(None).cast(entries.schema["year"].dataType))
    groups = entries.withColumn("every", F.lit(False)).unionByName(every.withColumn("every", F.lit(True)))
    of_class = stored(groups.groupBy("every", "b", "model", "year", *told_of).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.min("code").alias("code"), two_largest(F.collect_list("detail")).alias("ds"), least_by("detail").alias("longest")))

    # a year's entries, else the brand's, else, without a year, the brand's for all years
    asked = keys.select("b", "q_model", "q_year").distinct().join(entries.where("year is not null").select("b", F.col("year").alias("q_year"), F.lit("year").alias("way")).distinct(), ["b", "q_year"], "left")
    asked = asked.withColumn("way", F.when(F.col("q_year").isNull(), "every").otherwise(F.coalesce("way", F.lit("brand")))).withColumns({"at": F.when(F.col("way") == "year", F.col("q_year")).otherwise(0), "q": F.struct(*KEY)})
    ways = F.when(F.col("every"), F.array(F.lit("every"))).when(F.col("year").isNull(), F.array(F.lit("brand"))).otherwise(F.array(F.lit("year"), F.lit("brand")))
    offered = of_class.groupBy("every", "b", "model", "year").agg(F.sum("n").alias("n")).withColumn("way", F.explode(ways)).withColumn("at", F.when(F.col("way") == "year", F.col("year")).otherwise(0))
    models = stored(model_pairs(keys, entries))
    alike = asked.join(models, ["b", "q_model"]).join(offered, ["b", "model", "way", "at"]).withColumn("alike", F.lit(True))
    others = asked.join(alike.select("q").distinct(), "q", "left_anti")
    unlike = with_model_scores(others.join(offered, ["b", "way", "at"]), others, entries, sm=T.similarity(F.col("q_model"), F.col("model"), 0.9)).withColumn("alike", F.lit(False))
    sy = M.year_closeness(F.col("q_year"), F.col("year"))
    own = ["q", "way", "alike", "sm", F.struct("every", "b", "model", "year").alias("e"), "n"]
    met = stored(alike.select(*own, sy.alias("sy")).unionByName(unlike.select(*own, sy.alias("sy"))))

    base = 0.35 * F.col("sm") + 0.15 * F.col("sy")
    best = met.groupBy("q", "way", "alike").agg(F.sum("n").alias("candidates"), F.max(base).alias("top"))
    near = met.join(best.select("q", "top"), "q").where(base >= F.col("top") - (0.1 + within + 1e-5)).select("q", "sm", "sy", "e")
    near = near.join(of_class.select(F.struct("every", "b", "model", "year").alias("e"), "m", "code", "ds", "longest", *told_of), "e").withColumn("year", F.col("e.year"))
    exact = F.col("year") == F.col("q.q_year")
    years = F.when(F.col("m") > 1, F.array("year", "year")).otherwise(F.array("year"))
    classes = near.groupBy("q", "sm", "sy", *told_of).agg(
        F.sum("m").alias("m"), F.min("code").alias("code"), F.sum(F.when(exact, F.col("m")).otherwise(0)).alias("exact"), F.min(F.when(exact, F.col("code"))).alias("exact_code"),
        two_largest(F.flatten(F.collect_list(F.when(F.col("year").isNotNull(), years)))).alias("ys"), least_by("year").alias("newest"), two_largest(F.flatten(F.collect_list("ds"))).alias("ds"), F.min("longest").alias("longest"),
    )
    classes = classes.groupBy("q").agg(F.collect_list(F.struct("sm", "sy", *told_of, "m", "code", "exact", "exact_code", "ys", "newest", "ds", "longest")).alias("classes"))

    mine = {a: F.col(a) for a in ATTRIBUTES}
    attr = lambda e: attribute_score(mine, {a: e(f"e_{a}") for a in ATTRIBUTES})
    score = lambda sm, sy, attr: F.round(0.4 + 0.35 * sm + 0.15 * sy + 0.1 * attr, 6)
    held = lambda x: sum(x[c].isNotNull().cast("int") for c in told_of) / 3.0
    scored = F.transform("classes", lambda x: F.struct(
        score(x["sm"], x["sy"], attr(lambda c: x[c])).alias("score"), F.round(held(x), 6).alias("full"), F.round(x["sm"] + x["sy"], 6).alias("strength"), *(x[c].alias(c) for c in ("m", "code", "exact", "exact_code", "ys", "newest", "ds", "longest")),
    ))
    by_key = keys.select(F.struct(*KEY).alias("q"), *ATTRIBUTES).join(classes, "q").select("q", *ATTRIBUTES, scored.alias("scored")).withColumn("best", F.array_max(F.transform("scored", lambda x: x["score"])))
    by_key = by_key.select("q", *ATTRIBUTES, F.filter("scored", lambda x: F.round(F.col("best") - x["score"], 6) <= within).alias("tie_set"))
    # stored, as the join's filter of null codes would be pushed below and work every tie set out again for each of its uses
    by_key = stored(by_key.select("q", *ATTRIBUTES, F.aggregate("tie_set", F.lit(0).cast("long"), lambda t, x: t + x["m"]).alias("tied"), winner(F.col("tie_set")).alias("code"))).join(best.drop("top"), "q")

    # what the winner looks like: a code may be in the catalogue again under another model
    won = by_key.select("q.*", *ATTRIBUTES, "candidates", "tied", "code", "alike", "way").withColumn("every", F.col("way") == "every").join(groups.drop("n", "detail"), ["every", "b", "code"])
    won = won.where((F.col("way") != "year") | (F.col("year") == F.col("q_year"))).join(models.select("b", "q_model", "model", F.lit(True).alias("_alike")), ["b", "q_model", "model"], "left").where(~F.col("alike") | F.col("_alike"))
    full = sum(F.col(c).isNotNull().cast("int") for c in ("q_model", "q_year", *ATTRIBUTES)) / 10.0 + 0.1
    won = won.withColumns({"sm": T.similarity(F.col("q_model"), F.col("model"), 0.9), "sy": sy, "attr": attr(F.col), "full_of": full, "used": F.col("tied") > 1, "by_year": F.col("way") == "year"}).withColumn("score", score(F.col("sm"), F.col("sy"), F.col("attr")))
    found = won.groupBy(*KEY, *ATTRIBUTES).agg(F.max_by(F.struct("candidates", "code", "score", "tied", "used", "sm", "sy", "attr", "full_of", F.col("model").alias("m_model"), F.col("year").alias("m_year"), "by_year", "alike", *told_of), F.struct("score", "model")).alias("w"))
    found = found.select(*KEY, *ATTRIBUTES, "w.*")
    out = back(records, found, *ATTRIBUTES)
    status = F.when(error.isNotNull(), "ERROR").when(F.col("code").isNull(), "NO_MATCH").otherwise("MATCHED")
    hit = status == "MATCHED"
    confidence = F.when(hit, F.round(H.domain_confidence(F.col("score"), F.lit(1.0), F.col("sm"), F.col("sy"), F.col("full_of"), 0.5 + F.col("full_of") / 2), 6)).otherwise(0.0)
    same = lambda name, c: F.when(hit & F.coalesce(c, F.lit(False)), name)
    matches = F.concat_ws(",", same("brand", F.lit(True)), same("model", F.col("sm") >= 0.9), same("year", F.col("q_year") == F.col("m_year")), *(same(a, F.col(a) == F.col(f"e_{a}")) for a in ATTRIBUTES))
    warnings = F.concat_ws("; ", F.when(status == "ERROR", F.concat(F.lit("Error: "), error)), F.when(status == "NO_MATCH", "No matching vehicle found in dataset"), F.when(hit & (confidence < 0.7), "Low confidence match - manual review recommended").when(hit & (confidence < 0.85), "Medium confidence match - consider review"),
                           F.when(hit & F.col("q_year").isNull(), "Year not provided in Excel data"), F.when(hit & (F.col("sm") < 0.9), F.concat(F.lit("Model mismatch: Excel '"), F.col("q_model"), F.lit("' vs matched '"), F.col("m_model"), F.lit("'"))))
    strategy = F.when(hit, F.concat_ws("_", F.lit("brand"), F.when(F.col("by_year"), "year"), F.when(F.col("alike"), "model"))).otherwise(F.lower(status))
    of = lambda c, other: F.when(hit, F.col(c)).otherwise(F.lit(other))
    return out.select(
        "query_id", status.alias("status"), of("code", None).alias("code"), strategy.alias("strategy"), of("candidates", 0).cast("long").alias("candidates"), of("score", 0.0).alias("score"), of("tied", 0).cast("long").alias("tied"), of("used", False).alias("tie_break"),
        confidence.alias("confidence"), T.case_level(confidence, 0.9, 0.7, 0.5).alias("level"), M.decide(confidence, thresholds).alias("decision"), matches.alias("matches"), warnings.alias("warnings"),
    )
