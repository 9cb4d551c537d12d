"""The whole flow of matching as one query and its SQL; attribute classes and models as in records.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vehicle as H
from tessera.operators import flow as L
from tessera.plans.contract import DIRTY_SQL, _sim_sql, catalogue, dirty, register, spread, table
from tessera.plans.fuzzy import ratio_sql
from tessera.plans.records import PREPROCESSED_SQL, _any_sql, _parts_sql, preprocessed

_TOLD = ", ".join(f"CASE WHEN {_any_sql('v.text', info)} THEN coalesce({_parts_sql('v.text', parts)}, '?') END AS e_{n}" for n, parts, info in (("fuel", H.FUEL_PARTS, H.FUEL_PARTS), ("drivetrain", H.DRIVETRAIN_PARTS, H.DRIVETRAIN_PARTS), ("body", H.BODY_PARTS, H.BODY_INFO)))
_SUM = lambda what: " + ".join(f"CASE WHEN {n} IS NOT NULL AND e_{n} IS NOT NULL {what.format(n=n)} THEN {H.ATTRIBUTE_WEIGHTS[n]} ELSE 0 END" for n in L.ATTRIBUTES)
_ALL = "fuel, drivetrain, body"
MATCH_SQL = f"""
r AS (SELECT query_id, CASE WHEN query_id % 11 = 0 THEN 'NOBRAND' WHEN query_id % 19 <> 0 THEN q_brand END AS q_brand, q_model, q_year, {_ALL}, CASE WHEN query_id % 13 = 0 THEN 'Vehicle description is required' END AS error FROM q JOIN pp ON k = query_id),
e AS (SELECT code, upper(trim(brand)) AS b, model, year, length(v.text) AS detail, {_TOLD} FROM c JOIN v ON v.k = code),
kk AS (SELECT DISTINCT b, year FROM e),
p AS (SELECT query_id, q_model, q_year, {_ALL}, code, model, CASE WHEN q_year IS NOT NULL THEN e.year END AS y, detail, e_fuel, e_drivetrain, e_body, kk.b IS NOT NULL AS by_year FROM r LEFT JOIN kk ON upper(trim(q_brand)) = kk.b AND q_year = kk.year JOIN e ON upper(trim(q_brand)) = e.b AND (kk.b IS NULL OR e.year = q_year) WHERE error IS NULL),
g AS (SELECT query_id, q_model, q_year, {_ALL}, model, y, detail, e_fuel, e_drivetrain, e_body, by_year, count(*) AS n, min(code) AS code FROM p GROUP BY ALL),
m AS (SELECT q_model, model, {_sim_sql("q_model", "model", 0.9)} AS sm, upper(trim(q_model)) = upper(trim(model)) OR contains(upper(trim(q_model)), upper(trim(model))) OR contains(upper(trim(model)), upper(trim(q_model))) OR {ratio_sql("upper(trim(q_model))", "upper(trim(model))")} >= 0.8 AS alike FROM (SELECT DISTINCT q_model, model FROM g)),
s0 AS (SELECT *, bool_or(alike) OVER (PARTITION BY query_id) AS any_alike, CASE WHEN q_year IS NULL THEN 0.0 WHEN abs(q_year - y) = 0 THEN 1.0 WHEN abs(q_year - y) = 1 THEN 0.9 WHEN abs(q_year - y) = 2 THEN 0.7 WHEN abs(q_year - y) <= 5 THEN 0.5 ELSE 0.1 END AS sy,
  CASE WHEN fuel IS NULL AND drivetrain IS NULL AND body IS NULL THEN 0.5 WHEN ({_SUM("")}) = 0 THEN 0.3 ELSE ({_SUM("AND {n} = e_{n}")}) / ({_SUM("")}) END::DOUBLE AS attr FROM g JOIN m USING (q_model, model)),
s AS (SELECT *, round(0.4 + 0.35 * sm + 0.15 * sy + 0.1 * attr, 6) AS score, round(((e_fuel IS NOT NULL)::INT + (e_drivetrain IS NOT NULL)::INT + (e_body IS NOT NULL)::INT) / 3.0, 6) AS filled, round(sm + sy, 6) AS strength FROM s0 WHERE alike OR NOT any_alike),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS pos FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM s) WHERE round(best - score, 6) <= 0.05),
w AS (SELECT query_id, count(*) AS tied, min_by(code, pos) AS first, count(*) FILTER (y = q_year) AS exact, min(code) FILTER (y = q_year) AS exact_code, list(filled ORDER BY filled DESC) AS fulls, min_by(code, (-filled, pos)) AS fullest, max(y) AS newest, list(y ORDER BY y DESC) AS years, min_by(code, (-y, pos)) AS newest_code,
  max(strength) AS strongest, min_by(code, (-strength, pos)) AS strong_code, list(detail ORDER BY detail DESC) AS details, min_by(code, (-detail, pos)) AS detail_code FROM t GROUP BY query_id),
x AS (SELECT query_id, tied, CASE WHEN tied = 1 THEN first WHEN exact = 1 THEN exact_code WHEN round(fulls[1] - fulls[2], 6) >= 0.2 THEN fullest WHEN newest IS NOT NULL AND len(list_filter(years, lambda z: z = newest)) = 1 THEN newest_code WHEN strongest > 1.5 THEN strong_code WHEN details[1] > details[2] * 1.2 THEN detail_code ELSE first END AS code FROM w),
b AS (SELECT x.*, s.score, s.sm, s.sy, s.model, s.y, s.by_year, s.alike, s.e_fuel, s.e_drivetrain, s.e_body, (SELECT sum(n) FROM s s2 WHERE s2.query_id = x.query_id)::BIGINT AS candidates FROM x JOIN s ON s.query_id = x.query_id AND s.code = x.code),
f AS (SELECT r.query_id, r.error, r.q_model, r.q_year, r.fuel, r.drivetrain, r.body, b.* EXCLUDE (query_id), CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN b.code IS NULL THEN 'NO_MATCH' ELSE 'MATCHED' END AS status,
  ((r.q_model IS NOT NULL)::INT + (r.q_year IS NOT NULL)::INT + (r.fuel IS NOT NULL)::INT + (r.drivetrain IS NOT NULL)::INT + (r.body IS NOT NULL)::INT) / 10.0::DOUBLE + 0.1 AS filled FROM r LEFT JOIN b USING (query_id)),
z AS (SELECT *, CASE WHEN status = 'MATCHED' THEN round(least(1.0, score + CASE WHEN 0.5 + filled / 2 > 0.8 THEN 0.1 * (0.5 + filled / 2) ELSE 0 END + 0.05 * filled + 0.05 + CASE WHEN sm >= 0.9 THEN 0.05 ELSE 0 END + CASE WHEN sy >= 0.9 THEN 0.03 ELSE 0 END), 6) ELSE 0.0 END AS confidence FROM f)"""


@register(f"""WITH {DIRTY_SQL}, {PREPROCESSED_SQL}, {MATCH_SQL}
SELECT query_id, status, code, CASE WHEN status = 'MATCHED' THEN 'brand' || CASE WHEN by_year THEN '_year' ELSE '' END || CASE WHEN alike THEN '_model' ELSE '' END ELSE lower(status) END AS strategy, coalesce(candidates, 0) AS candidates, coalesce(score, 0.0) AS score, coalesce(tied, 0) AS tied, coalesce(tied > 1, false) AS tie_break,
  confidence, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' WHEN confidence >= 0.5 THEN 'low' ELSE 'very_low' END AS level, CASE WHEN confidence >= 0.9 THEN 'auto_accept' WHEN confidence >= 0.7 THEN 'needs_review' ELSE 'no_match' END AS decision,
  CASE WHEN status = 'MATCHED' THEN concat_ws(',', 'brand', CASE WHEN sm >= 0.9 THEN 'model' END, CASE WHEN q_year = y THEN 'year' END, CASE WHEN fuel = e_fuel THEN 'fuel' END, CASE WHEN drivetrain = e_drivetrain THEN 'drivetrain' END, CASE WHEN body = e_body THEN 'body' END) ELSE '' END AS matches,
  concat_ws('; ', 'Error: ' || error, CASE WHEN status = 'NO_MATCH' THEN 'No matching vehicle found in dataset' END, CASE WHEN status = 'MATCHED' AND confidence < 0.7 THEN 'Low confidence match - manual review recommended' WHEN status = 'MATCHED' AND confidence < 0.85 THEN 'Medium confidence match - consider review' END,
    CASE WHEN status = 'MATCHED' AND q_year IS NULL THEN 'Year not provided in Excel data' END, CASE WHEN status = 'MATCHED' AND sm < 0.9 THEN 'Model mismatch: Excel ''' || q_model || ''' vs matched ''' || model || '''' END) AS warnings FROM z
""")
def match_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through the whole flow: candidates, scores, ties, results, and rows for those without a match or with an error."""
    parts, k = spread(table(spark, sf_dir, "part"), "p_partkey"), F.col("query_id")
    text = preprocessed(parts).select(F.col("k").alias("query_id"), "text", *L.ATTRIBUTES)
    brand = F.when(k % 11 == 0, "NOBRAND").when(k % 19 != 0, F.col("q_brand"))
    records = dirty(parts).withColumn("q_brand", brand).join(text.drop("text"), "query_id")
    entries = catalogue(parts).drop("description").join(text.select(k.alias("code"), F.col("text").alias("description")), "code")
    return L.match_records(records, entries, F.when(k % 13 == 0, "Vehicle description is required"))


@register(f"""WITH {DIRTY_SQL}, {PREPROCESSED_SQL}, {MATCH_SQL}, d AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 'auto_accept' WHEN confidence >= 0.7 THEN 'needs_review' ELSE 'no_match' END AS decision FROM z)
SELECT count(*) AS rows_total, count(*) FILTER (decision = 'auto_accept') AS auto_accept, count(*) FILTER (decision = 'needs_review') AS needs_review, count(*) FILTER (decision = 'no_match') AS no_match, count(*) FILTER (status = 'ERROR') AS errors, count(*) FILTER (tied > 1) AS ties, round(count(*) FILTER (code = query_id) / greatest(count(code), 1), 6) AS top1 FROM d
""")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the whole flow counts, and how often its code is the entry that the record was written of."""
    d = match_records(spark, sf_dir)
    of = lambda c: F.count_if(F.col("decision") == c).alias(c)
    hit = F.count_if(F.col("code") == F.col("query_id")) / F.greatest(F.count("code"), F.lit(1))
    return d.agg(F.count(F.lit(1)).alias("rows_total"), of("auto_accept"), of("needs_review"), of("no_match"), F.count_if(F.col("status") == "ERROR").alias("errors"), F.count_if(F.col("tied") > 1).alias("ties"), F.round(hit, 6).alias("top1"))
