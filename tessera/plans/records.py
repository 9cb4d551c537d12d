"""Queries of records, rows and mails and their SQL, side by side.

Stand-ins: vehicle descriptions are written from `part` with words of the trade; rows of runs and results are `lineitem`; cases
are `orders`; senders are `customer`. Word lists and rules come from tessera.functions, in code and SQL alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.functions import vehicle as H
from tessera.operators import flow as L
from tessera.operators import matching as M
from tessera.operators import profile as P
from tessera.plans.contract import catalogue, dirty, register, spread, table
from tessera.plans.contract import DIRTY_SQL, _sim_sql

WORDS = ("diesel", "GASOLINA", "4x4", "AWD", "DC", "sedan", "SUV", "v6", "turbo", "automatico", "manual", "quemacocos", "hybrid", "abs", "cvt", "2dr", "hatchback", "sport", "ac", "rwd", "TDI", "pickup", "4P", "limited")
_LIST = "[" + ", ".join(f"'{w}'" for w in WORDS) + "]"


def vehicles(parts: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    word = lambda n: F.element_at(F.array(*map(F.lit, WORDS)), (n % len(WORDS) + 1).cast("int"))
    text = F.concat_ws(" ", F.when(k % 6 == 0, F.col("p_brand")), "p_brand", "p_name", F.when(k % 5 != 0, (1990 + F.col("p_size")).cast("string")), F.concat(word(k), F.lit(",")), word(k * 7 + 3))
    return parts.select(k.alias("k"), text.alias("text"))


VEHICLES_SQL = f"""
v AS (SELECT p_partkey AS k, concat_ws(' ', CASE WHEN p_partkey % 6 = 0 THEN p_brand END, p_brand, p_name, CASE WHEN p_partkey % 5 <> 0 THEN (1990 + p_size)::VARCHAR END,
  {_LIST}[(p_partkey % {len(WORDS)} + 1)::INT] || ',', {_LIST}[((p_partkey * 7 + 3) % {len(WORDS)} + 1)::INT]) AS text FROM part)"""


def _words_sql(c: str, words: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '\\b{w}\\b') THEN '{n}'" for w, n in words.items()) + " END"


def _parts_sql(c: str, parts: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN contains(upper({c}), '{w}') THEN '{n}'" for w, n in parts.items()) + " END"


def _any_sql(c: str, parts) -> str:
    return "(" + " OR ".join(f"contains(upper({c}), '{w}')" for w in parts) + ")"


PREPROCESSED_SQL = VEHICLES_SQL + f""",
p0 AS (SELECT k, text, trim(regexp_replace(regexp_replace(upper(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS c FROM v),
p1 AS (SELECT k, text, CASE WHEN split_part(c, ' ', 1) = split_part(c, ' ', 2) THEN substr(c, length(split_part(c, ' ', 1)) + 2) ELSE c END AS c FROM p0),
p2 AS (SELECT k, text, TRY_CAST(nullif(regexp_extract(c, '\\b((?:19|20)[0-9]{{2}})\\b', 1), '') AS INT) AS year, trim(regexp_replace(regexp_replace(c, '\\b(?:19|20)[0-9]{{2}}\\b', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM p1),
pp AS (SELECT k, text, cleaned, year, CASE split_part(cleaned, ' ', 1) WHEN 'VW' THEN 'VOLKSWAGEN' ELSE nullif(split_part(cleaned, ' ', 1), '') END AS brand, nullif(split_part(cleaned, ' ', 2), '') AS model,
  {_words_sql("cleaned", H.FUEL_WORDS)} AS fuel, {_words_sql("cleaned", H.DRIVETRAIN_WORDS)} AS drivetrain, {_words_sql("cleaned", H.BODY_WORDS)} AS body FROM p2)"""


def preprocessed(parts: DataFrame) -> DataFrame:
    """The fields of H.preprocess, a step at a time: as one expression each field would clean the text again, and more than once."""
    v = vehicles(parts).withColumn("cleaned", T.clean_description(F.col("text"))).withColumn("cleaned", H.undoubled(F.col("cleaned"))).withColumn("year", T.first_year(F.col("cleaned")))
    v = v.withColumn("cleaned", H.without_years(F.col("cleaned"), F.col("year"))).withColumns(H.parts_of(F.col("cleaned")))
    return v.select("k", "text", "cleaned", "brand", "model", "year", "fuel", "drivetrain", "body")


@register(f"WITH {PREPROCESSED_SQL} SELECT k, cleaned, brand, model, year, fuel, drivetrain, body FROM pp")
def preprocess_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned description and the attributes read from it."""
    return preprocessed(table(spark, sf_dir, "part")).drop("text")


def _expanded_sql(c: str) -> str:
    x = f"trim(regexp_replace(regexp_replace(lower(trim({c})), '[^A-Za-z0-9_\\s.\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for short, long in H.ABBREVIATIONS.items():
        x = f"regexp_replace({x}, '\\b{short}\\b', '{long}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_FEATURES_SQL = ", ".join(
    "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(x, '{'|'.join(chr(92) + 'b' + w + chr(92) + 'b' for w in own)}') THEN '{n}' END" for n, own in names.items()) + f") AS {g}" for g, names in H.FEATURES.items()
)


@register(f"WITH {VEHICLES_SQL}, e AS (SELECT k, {_expanded_sql('text')} AS x FROM v) SELECT k, x AS expanded, {_FEATURES_SQL}, concat_ws(',', " + ", ".join(f"CASE WHEN contains(x, '{w}') THEN '{w.replace(' ', '_')}' END" for w in H.KEYWORDS) + ") AS features FROM e")
def vehicle_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded text and its features by group."""
    e = vehicles(table(spark, sf_dir, "part")).select("k", H.expanded(F.col("text")).alias("x"))
    return e.select("k", F.col("x").alias("expanded"), *(F.array_join(c, ",").alias(g) for g, c in H.features(F.col("x")).items()))


@register(f"""WITH {VEHICLES_SQL} SELECT k, {_parts_sql("text", H.FUEL_PARTS)} AS fuel, {_parts_sql("text", H.DRIVETRAIN_PARTS)} AS drivetrain, {_parts_sql("text", H.BODY_PARTS)} AS body,
  {_any_sql("text", H.FUEL_PARTS)} AS has_fuel, {_any_sql("text", H.DRIVETRAIN_PARTS)} AS has_drivetrain, {_any_sql("text", H.BODY_INFO)} AS has_body, {_any_sql("text", H.TRIM_INFO)} AS has_trim FROM v""")
def attribute_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by parts of the text, and whether it tells an attribute at all."""
    t = F.col("text")
    return vehicles(table(spark, sf_dir, "part")).select(
        "k", H.first_part_class(t, H.FUEL_PARTS).alias("fuel"), H.first_part_class(t, H.DRIVETRAIN_PARTS).alias("drivetrain"), H.first_part_class(t, H.BODY_PARTS).alias("body"),
        H.holds_any(t, H.FUEL_PARTS).alias("has_fuel"), H.holds_any(t, H.DRIVETRAIN_PARTS).alias("has_drivetrain"), H.holds_any(t, H.BODY_INFO).alias("has_body"), H.holds_any(t, H.TRIM_INFO).alias("has_trim"))


def _allows_sql(x: str, d: str, variants: dict) -> str:
    return f"CASE WHEN {x} IS NULL THEN true " + " ".join(f"WHEN {x} = '{n}' THEN {_any_sql(d, own)}" for n, own in variants.items()) + f" ELSE contains(upper({d}), {x}) END"


def _told_sql(x: str, d: str, info) -> str:
    return f"({x} IS NOT NULL AND {_any_sql(d, info)})"


_ATTR = (("fuel", H.FUEL_PARTS, H.FUEL_PARTS), ("drivetrain", H.DRIVETRAIN_PARTS, H.DRIVETRAIN_PARTS), ("body", H.BODY_PARTS, H.BODY_INFO))
_TOTAL = " + ".join(f"CASE WHEN {_told_sql('q.' + n, 'd.text', info)} AND {_parts_sql('d.text', parts)} = q.{n} THEN {H.ATTRIBUTE_WEIGHTS[n]} ELSE 0 END" for n, parts, info in _ATTR)
_WEIGHT = " + ".join(f"CASE WHEN {_told_sql('q.' + n, 'd.text', info)} THEN {H.ATTRIBUTE_WEIGHTS[n]} ELSE 0 END" for n, parts, info in _ATTR)
PAIR_SQL = PREPROCESSED_SQL + f""",
m AS (SELECT q.k, d.k AS code, q.brand AS q_brand, q.model AS q_model, q.year AS q_year, q.fuel, q.drivetrain, q.body, q.cleaned, d.text AS description, e.brand AS d_brand, e.cleaned AS d_cleaned, e.model AS d_model, e.year AS d_year,
  {_allows_sql("q.fuel", "d.text", H.FUEL_VARIANTS)} AS fuel_ok, {_allows_sql("q.drivetrain", "d.text", H.DRIVETRAIN_VARIANTS)} AS drive_ok, {_allows_sql("q.body", "d.text", H.BODY_VARIANTS)} AS body_ok,
  CASE WHEN q.fuel IS NULL AND q.drivetrain IS NULL AND q.body IS NULL THEN 0.5 WHEN ({_WEIGHT}) = 0 THEN 0.3 ELSE ({_TOTAL}) / ({_WEIGHT}) END::DOUBLE AS attr
  FROM pp q JOIN v d ON d.k BETWEEN q.k + 1 AND q.k + 2 JOIN pp e ON e.k = d.k)"""


def pairs(parts: DataFrame) -> DataFrame:
    """Each record with two entries of the catalogue, those with the next keys: pairs grow with the records."""
    q = preprocessed(spread(parts, "p_partkey"))
    d = q.select(F.col("k").alias("code"), F.col("text").alias("description"), *L.told(F.col("text")), F.col("brand").alias("d_brand"), F.col("model").alias("d_model"), F.col("year").alias("d_year"), F.col("cleaned").alias("d_cleaned"))
    q = q.withColumnsRenamed({"brand": "q_brand", "model": "q_model", "year": "q_year"}).drop("text").withColumn("code", F.explode(F.array(F.col("k") + 1, F.col("k") + 2)))
    t = F.col("description")
    return q.join(d, "code").withColumns({
        "fuel_ok": H.allows(F.col("fuel"), t, H.FUEL_VARIANTS), "drive_ok": H.allows(F.col("drivetrain"), t, H.DRIVETRAIN_VARIANTS), "body_ok": H.allows(F.col("body"), t, H.BODY_VARIANTS),
        "attr": L.attribute_score({a: F.col(a) for a in L.ATTRIBUTES}, {a: F.col(f"e_{a}") for a in L.ATTRIBUTES}),
    })


_COMBINED_SQL = """
s AS (SELECT *, round(0.6 * (fuel_ok::INT + drive_ok::INT + body_ok::INT + 0.5) / 3.5 + 0.15 * len(list_intersect(list_distinct(string_split(cleaned, ' ')), list_distinct(string_split(d_cleaned, ' '))))::DOUBLE
  / len(list_distinct(list_concat(string_split(cleaned, ' '), string_split(d_cleaned, ' ')))), 6) AS combined FROM m),
r AS (SELECT *, row_number() OVER w AS rn, lead(combined) OVER w AS nx FROM s WINDOW w AS (PARTITION BY k ORDER BY combined DESC, code)),
f AS (SELECT *, greatest(0.0, least(1.0, round((combined + CASE WHEN q_brand = d_brand THEN 0.15 ELSE 0 END + CASE WHEN contains(d_model, q_model) THEN 0.15 ELSE 0 END + CASE WHEN q_year = d_year THEN 0.1 ELSE 0 END
  + 0.05 * fuel_ok::INT + 0.05 * drive_ok::INT + 0.05 * body_ok::INT - CASE WHEN round(combined - nx, 6) < 0.05 THEN 0.1 ELSE 0 END) * 0.8, 6))) AS confidence FROM r WHERE rn = 1)"""


@register(f"""WITH {PAIR_SQL}, {_COMBINED_SQL}
SELECT k, code, combined, confidence, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very_low' END AS level,
  concat_ws('; ', CASE WHEN confidence < 0.7 THEN 'Low confidence match - manual review recommended' WHEN confidence < 0.85 THEN 'Medium confidence match - consider review' END,
    CASE WHEN q_year IS NULL THEN 'Year not provided in Excel data' END, CASE WHEN q_brand <> d_brand THEN 'Brand mismatch: Excel ''' || q_brand || ''' vs matched ''' || d_brand || '''' END,
    CASE WHEN NOT contains(d_model, q_model) THEN 'Model mismatch: Excel ''' || q_model || ''' vs matched ''' || d_model || '''' END, CASE WHEN NOT fuel_ok THEN 'Fuel type mismatch detected' END, CASE WHEN NOT drive_ok THEN 'Drivetrain mismatch detected' END) AS warnings FROM f""")
def enhanced_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enhanced matcher: attribute checks, token overlap, combined score, confidence with boosts and penalty, warnings."""
    a, b = (F.array_distinct(F.split(c, " ")) for c in ("cleaned", "d_cleaned"))
    ok = [F.col(c).cast("int") for c in ("fuel_ok", "drive_ok", "body_ok")]
    p = pairs(table(spark, sf_dir, "part")).withColumn("combined", F.round(0.6 * (sum(ok) + 0.5) / 3.5 + 0.15 * T.jaccard(a, b), 6))
    w = Window.partitionBy("k").orderBy(F.desc("combined"), "code")
    best = p.withColumn("rn", F.row_number().over(w)).withColumn("nx", F.lead("combined").over(w)).where("rn = 1")
    boost = lambda c, n: F.when(c, n).otherwise(0.0)
    q, d = F.col("q_model"), F.col("d_model")
    raw = F.col("combined") + boost(F.col("q_brand") == F.col("d_brand"), 0.15) + boost(d.contains(q), 0.15) + boost(F.col("q_year") == F.col("d_year"), 0.1) + sum(0.05 * x for x in ok) - boost(F.round(F.col("combined") - F.col("nx"), 6) < 0.05, 0.1)
    best = best.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(raw * 0.8, 6))))
    c = F.col("confidence")
    mismatch = lambda what, x, y: F.concat(F.lit(f"{what} mismatch: Excel '"), x, F.lit("' vs matched '"), y, F.lit("'"))
    warnings = F.concat_ws("; ", F.when(c < 0.7, "Low confidence match - manual review recommended").when(c < 0.85, "Medium confidence match - consider review"), F.when(F.col("q_year").isNull(), "Year not provided in Excel data"),
                           F.when(F.col("q_brand") != F.col("d_brand"), mismatch("Brand", F.col("q_brand"), F.col("d_brand"))), F.when(~d.contains(q), mismatch("Model", q, d)),
                           F.when(~F.col("fuel_ok"), "Fuel type mismatch detected"), F.when(~F.col("drive_ok"), "Drivetrain mismatch detected"))
    return best.select("k", "code", "combined", "confidence", T.case_level(c, 0.9, 0.7, 0.5).alias("level"), warnings.alias("warnings"))


@register(f"""WITH {PAIR_SQL}, c AS (SELECT *, {_sim_sql("q_brand", "d_brand", 0.9, 1.2, 0.8)} AS sb, {_sim_sql("q_model", "d_model", 0.9)} AS sm,
  CASE WHEN q_year IS NULL OR d_year IS NULL THEN 0.0 WHEN abs(q_year - d_year) = 0 THEN 1.0 WHEN abs(q_year - d_year) = 1 THEN 0.9 WHEN abs(q_year - d_year) = 2 THEN 0.7 WHEN abs(q_year - d_year) <= 5 THEN 0.5 ELSE 0.1 END AS sy,
  ((q_brand IS NOT NULL)::INT + (q_model IS NOT NULL)::INT + (q_year IS NOT NULL)::INT + (fuel IS NOT NULL)::INT + (drivetrain IS NOT NULL)::INT + (body IS NOT NULL)::INT) / 10.0 AS filled FROM m),
t AS (SELECT *, 0.4 * sb + 0.35 * sm + 0.15 * sy + 0.1 * attr AS total FROM c)
SELECT k, code, round(attr, 6) AS attribute_score, round(total, 6) AS total, filled::DOUBLE AS completeness,
  round(least(1.0, total + CASE WHEN 0.5 + filled / 2 > 0.8 THEN 0.1 * (0.5 + filled / 2) ELSE 0 END + 0.05 * filled + CASE WHEN sb >= 0.9 THEN 0.05 ELSE 0 END + CASE WHEN sm >= 0.9 THEN 0.05 ELSE 0 END + CASE WHEN sy >= 0.9 THEN 0.03 ELSE 0 END), 6) AS confidence FROM t""")
def domain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component scores with attributes, completeness of the record, and confidence with its boosts."""
    p = pairs(table(spark, sf_dir, "part"))
    sb, sm, sy = M.domain_scores(*map(F.col, ("q_brand", "d_brand", "q_model", "d_model", "q_year", "d_year")))
    full = sum(F.col(c).isNotNull().cast("int") for c in ("q_brand", "q_model", "q_year", "fuel", "drivetrain", "body")) / 10.0
    total = 0.4 * sb + 0.35 * sm + 0.15 * sy + 0.1 * F.col("attr")
    return p.select("k", "code", F.round("attr", 6).alias("attribute_score"), F.round(total, 6).alias("total"), full.alias("completeness"), F.round(H.domain_confidence(total, sb, sm, sy, full, 0.5 + full / 2), 6).alias("confidence"))


@register("""
WITH c AS (SELECT l_orderkey AS q, l_linenumber AS code, round(1 - l_discount * 5, 6) AS score, year(l_shipdate) AS y, year(o_orderdate) AS qy, CASE WHEN l_quantity > 25 THEN 1.0 WHEN l_quantity > 10 THEN 0.9 ELSE 0.7 END AS filled,
  round(l_tax * 25, 6) AS strength, l_quantity::INT AS detail FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, code) AS pos FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM c) WHERE round(best - score, 6) <= 0.05),
g AS (SELECT q, count(*) AS n, min_by(code, pos) AS first, count(*) FILTER (y = qy) AS exact, min(code) FILTER (y = qy) AS exact_code, list(filled ORDER BY filled DESC) AS fulls, min_by(code, (-filled, pos)) AS fullest,
  max(y) AS newest, list(y ORDER BY y DESC) AS years, min_by(code, (-y, pos)) AS newest_code, max(strength) AS strongest, min_by(code, (-strength, pos)) AS strong_code, list(detail ORDER BY detail DESC) AS details, min_by(code, (-detail, pos)) AS detail_code FROM t GROUP BY q)
SELECT q AS query_id, n AS tied, CASE WHEN n = 1 THEN first WHEN exact = 1 THEN exact_code WHEN round(fulls[1] - fulls[2], 6) >= 0.2 THEN fullest WHEN len(list_filter(years, lambda x: x = newest)) = 1 THEN newest_code
  WHEN strongest > 1.5 THEN strong_code WHEN details[1] > details[2] * 1.2 THEN detail_code ELSE first END AS code, n > 1 AS used FROM g
""")
def tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of each tie set: one exact year, else a gap of completeness, one newest, strong components, more detail, the first."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("qy"))
    n = F.col("l_quantity")
    c = l.join(o, "l_orderkey").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("code"), F.round(1 - F.col("l_discount") * 5, 6).alias("score"), F.year("l_shipdate").alias("y"), "qy",
                                       F.when(n > 25, 1.0).when(n > 10, 0.9).otherwise(0.7).alias("full"), F.round(F.col("l_tax") * 25, 6).alias("strength"), n.cast("int").alias("detail"))
    return M.break_ties(c, "q").withColumnRenamed("q", "query_id")


@register("""
WITH r AS (SELECT l_suppkey AS batch, round(1 - l_discount * 5, 6) AS s, l_quantity AS ms, l_returnflag AS method, l_linestatus = 'F' AND l_linenumber = 1 AS failed FROM lineitem),
x AS (SELECT *, CASE WHEN s >= 0.9 THEN 'high' WHEN s >= 0.7 THEN 'medium' WHEN s >= 0.5 THEN 'low' ELSE 'very_low' END AS level FROM r)
SELECT batch, count(*) AS total, count(*) FILTER (level <> 'very_low' AND NOT failed) AS successful, count(*) FILTER (failed) AS failed, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low,
  count(*) FILTER (level = 'very_low') AS very_low, round(avg(ms), 6) AS average_ms, round(avg(s), 6) AS average_confidence, round(100.0 * count(*) FILTER (level <> 'very_low' AND NOT failed) / count(*), 6) AS success_rate,
  round(count(*) / (sum(ms) / 1000), 6) AS per_second, count(*) FILTER (method = 'A') AS by_a, count(*) FILTER (method = 'N') AS by_n, count(*) FILTER (method = 'R') AS by_r FROM x GROUP BY batch
""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of each batch: success, levels, averages, throughput, methods."""
    s, n = F.col("s"), F.count(F.lit(1))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("batch"), F.round(1 - F.col("l_discount") * 5, 6).alias("s"), F.col("l_quantity").alias("ms"), F.col("l_returnflag").alias("method"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("failed"))
    r = r.withColumn("level", T.case_level(s, 0.9, 0.7, 0.5))
    good = F.count_if((F.col("level") != "very_low") & ~F.col("failed"))
    return r.groupBy("batch").agg(
        n.alias("total"), good.alias("successful"), F.count_if("failed").alias("failed"), *(F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low", "very_low")), F.round(F.avg("ms"), 6).alias("average_ms"), F.round(F.avg("s"), 6).alias("average_confidence"),
        F.round(100.0 * good / n, 6).alias("success_rate"), F.round(n / (F.sum("ms") / 1000), 6).alias("per_second"), *(F.count_if(F.col("method") == x).alias(f"by_{x.lower()}") for x in "ANR"))


@register("""
SELECT o_custkey AS batch, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS remaining, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS percent,
  (sum(round(o_totalprice * 100)::BIGINT) FILTER (o_orderstatus = 'F') * count(*) FILTER (o_orderstatus <> 'F'))::DOUBLE / count(*) FILTER (o_orderstatus = 'F') AS eta FROM orders GROUP BY 1
""")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share done, remaining, and the expected cost (cents) of the rest by the mean of what is done."""
    done, n = F.col("o_orderstatus") == "F", F.count(F.lit(1))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(n.alias("total"), F.count_if(done).alias("done"), F.count_if(~done).alias("remaining"), F.round(100.0 * F.count_if(done) / n, 6).alias("percent"), ((F.sum(F.when(done, F.round(F.col("o_totalprice") * 100).cast("long"))) * F.count_if(~done)).cast("double") / F.count_if(done)).alias("eta"))


@register("""
WITH r AS (SELECT l_orderkey AS case_id, CASE WHEN l_returnflag = 'R' THEN 0 ELSE round(100 - l_discount * 500)::INT END AS c, l_returnflag = 'R' AS missing FROM lineitem),
g AS (SELECT case_id, count(*) AS n, count(*) FILTER (c > 0) AS valid, sum(c) FILTER (c > 0) AS total, bool_or(c < 50) AS low, bool_or(missing) AS missing FROM r GROUP BY 1),
k AS (SELECT *, round(coalesce(total / (100.0::DOUBLE * CASE WHEN valid < 0.8 * n THEN n ELSE valid END), 0), 6) AS confidence FROM g)
SELECT case_id, confidence, CASE WHEN confidence >= 0.7 THEN 'PROCESSED' ELSE 'NEEDS_REVIEW' END AS status, concat_ws(',', CASE WHEN low THEN 'vehicle_matching_confidence' END, CASE WHEN missing THEN 'vehicle_cvegs_codes' END) AS missing_fields FROM k
""")
def case_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the scores above 0, times the match rate where it is below 0.8; the case's status and what it lacks."""
    lost = F.col("l_returnflag") == "R"
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(lost, 0).otherwise(F.round(100 - F.col("l_discount") * 500).cast("int")).alias("c"), lost.alias("missing"))
    valid = F.col("c") > 0
    g = r.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("valid"), F.sum(F.when(valid, F.col("c"))).alias("total"), F.bool_or(F.col("c") < 50).alias("low"), F.bool_or("missing").alias("missing"))
    k = g.withColumn("confidence", F.round(F.coalesce(F.col("total") / (100.0 * F.when(F.col("valid") < 0.8 * F.col("n"), F.col("n")).otherwise(F.col("valid"))), F.lit(0.0)), 6))
    return k.select("case_id", "confidence", F.when(F.col("confidence") >= 0.7, "PROCESSED").otherwise("NEEDS_REVIEW").alias("status"), F.concat_ws(",", F.when(F.col("low"), "vehicle_matching_confidence"), F.when(F.col("missing"), "vehicle_cvegs_codes")).alias("missing_fields"))


RULES = {"l_returnflag": {"required": True, "allowed_values": ("A", "N")}, "l_quantity": {"min_value": 5, "max_value": 45}, "l_linestatus": {"pattern": "F|P"}, "l_comment": {"min_length": 3, "max_length": 5}}


@register("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_linestatus, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE left('abcdefghij', 1 + (l_orderkey % 8)::INT) END AS l_comment FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'l_returnflag must be one of: A, N' END, CASE WHEN l_quantity < 5 THEN 'l_quantity must be at least 5' END, CASE WHEN l_quantity > 45 THEN 'l_quantity must be at most 45' END,
  CASE WHEN NOT regexp_matches(l_linestatus, '^(?:F|P)') THEN 'l_linestatus does not match required pattern' END, CASE WHEN length(l_comment) < 3 THEN 'l_comment must be at least 3 characters' END, CASE WHEN length(l_comment) > 5 THEN 'l_comment must be at most 5 characters' END) AS errors FROM r
""")
def field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the rule compiler for each row."""
    note = F.when(F.col("l_linenumber") % 3 != 0, F.substring(F.lit("abcdefghij"), F.lit(1), (1 + F.col("l_orderkey") % 8).cast("int")))
    return table(spark, sf_dir, "lineitem").withColumn("l_comment", note).select("l_orderkey", "l_linenumber", F.array_join(P.row_errors(RULES), "; ").alias("errors"))


PLATES = ("ABC 123", "ab", "N/A", "test", "ABCDE 12345 X", "xy-12")
_PLATES = "[" + ", ".join(f"'{x}'" for x in PLATES) + "]"


@register(f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice - 3000 AS insured, (l_extendedprice - 3000) * (l_tax * 10 - 0.1) AS premium, 1880 + (l_partkey % 160)::INT AS y, CASE WHEN l_linenumber % 2 = 0 THEN 'Tesla' ELSE 'Ford' END AS brand, {_PLATES}[(l_suppkey % 6 + 1)::INT] AS plate FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN y < 1900 THEN 'Year ' || y || ' is too old (minimum: 1900)' WHEN y > 2027 THEN 'Year ' || y || ' is in the future' END,
  CASE WHEN length(plate) < 3 OR length(plate) > 10 THEN 'License plate length unusual: ' || length(plate) || ' characters' END, CASE WHEN lower(plate) IN ('n/a', 'na', 'none', 'null', 'test') THEN 'Invalid license plate: ' || plate END,
  CASE WHEN insured <> 0 AND insured < 1000 THEN 'Insured value seems too low (< $1,000)' WHEN insured > 10000000 THEN 'Insured value seems too high (> $10,000,000)' END,
  CASE WHEN insured <> 0 AND premium <> 0 AND premium / insured > 0.5 THEN 'Premium seems too high relative to insured value' WHEN insured <> 0 AND premium <> 0 AND premium / insured < 0.001 THEN 'Premium seems too low relative to insured value' END,
  CASE WHEN brand = 'Tesla' AND y < 2008 THEN 'Tesla did not manufacture vehicles in ' || y END) AS errors FROM r
""")
def business_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year, plate and business messages for each row."""
    insured = F.col("l_extendedprice") - 3000
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", insured.alias("insured"), (insured * (F.col("l_tax") * 10 - 0.1)).alias("premium"), (1880 + F.col("l_partkey") % 160).cast("int").alias("y"), F.when(F.col("l_linenumber") % 2 == 0, "Tesla").otherwise("Ford").alias("brand"), F.element_at(F.array(*map(F.lit, PLATES)), (F.col("l_suppkey") % 6 + 1).cast("int")).alias("plate"))
    errors = F.concat(V.year_errors(F.col("y").cast("string"), 2025), V.plate_errors(F.col("plate")), V.business_errors(F.col("insured"), F.col("premium"), F.col("y"), F.col("brand")))
    return r.select("l_orderkey", "l_linenumber", F.array_join(errors, "; ").alias("errors"))


PROFILE = P.Profile(required=("marca", "modelo"), columns={"marca": "brand", "modelo": "model", "anio": "year"}, normalize={"brand": ("lower", "strip"), "model": ("strip",)}, compute={"label": "{brand} {model} {year}", "key": "{label}/{unknown}"}, ranges={"year": (2000, 2030)}, enums={"kind": ("ECONOMY", "STANDARD")})
PROFILE_SQL = """r AS (SELECT p_partkey AS k, lower(trim(p_brand || ' ')) AS brand, trim(p_name) AS model, CASE WHEN p_partkey % 7 = 0 THEN 'x' || p_size WHEN p_partkey % 9 <> 0 THEN (1990 + p_size)::VARCHAR END AS year, p_type AS kind FROM part),
f AS (SELECT *, brand || ' ' || model || ' ' || coalesce(year, '') AS label, NOT coalesce(regexp_matches(year, '^[0-9]{4}$') AND TRY_CAST(year AS DOUBLE) BETWEEN 2000 AND 2030, false) AS year_range, NOT coalesce(kind IN ('ECONOMY', 'STANDARD'), false) AS kind_enum FROM r)"""


def sheet(parts: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return parts.select(k.alias("K"), F.concat("p_brand", F.lit(" ")).alias(" Marca "), F.col("p_name").alias("MODELO"), F.when(k % 7 == 0, F.concat(F.lit("x"), F.col("p_size").cast("string"))).when(k % 9 != 0, (1990 + F.col("p_size")).cast("string")).alias("Anio"), F.col("p_type").alias("kind"))


@register(f"WITH {PROFILE_SQL} SELECT k, brand, model, year, kind, label, label || '/${{unknown}}' AS key, year_range, kind_enum FROM f")
def profile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile over a sheet: headers, mapping, normalisation, templates, rules."""
    return P.apply_profile(sheet(table(spark, sf_dir, "part")), PROFILE)[0]


@register(f"WITH {PROFILE_SQL} SELECT 'year_range' AS rule, count(*) FILTER (year_range) AS n FROM f UNION ALL SELECT 'kind_enum', count(*) FILTER (kind_enum) FROM f")
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each rule of the profile."""
    return P.report(P.apply_profile(sheet(table(spark, sf_dir, "part")), PROFILE)[0], ["year_range", "kind_enum"])
