"""Queries of row numbers, rules with policies, stored rows that are updated, deep pages and thresholds, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import pages as G
from tessera.operators import rules as U
from tessera.operators.ordinals import numbered
from tessera.plans import contract
from tessera.plans.contract import register, table
from tessera.sources import versions as V
from tessera.sources.files import work_dir


@register("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS row_index FROM lineitem")
def row_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each row in the order of its date, from 0 on."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return numbered(rows, [F.asc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber")], "row_index").drop("l_shipdate")


@register("""
SELECT 'run_' || l_suppkey AS run_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS row_index, l_orderkey, l_linenumber,
  '{"l_orderkey":"' || l_orderkey || '","l_linenumber":"' || l_linenumber || '","l_returnflag":"' || l_returnflag || '"}' AS raw_data FROM lineitem
""")
def row_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the number in their run and the raw row as text by column; a run of any size is numbered by ranges."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    order = ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber"]
    n = numbered(rows, [F.asc(c) for c in order], "n")
    first = n.groupBy("l_suppkey").agg(F.min("n").alias("first"))
    raw = F.to_json(F.create_map(*(x for c in ("l_orderkey", "l_linenumber", "l_returnflag") for x in (F.lit(c), F.col(c).cast("string")))))
    return n.join(first, "l_suppkey").select(F.concat(F.lit("run_"), F.col("l_suppkey").cast("string")).alias("run_id"), (F.col("n") - F.col("first")).alias("row_index"), "l_orderkey", "l_linenumber", raw.alias("raw_data"))


PROFILE = {
    "transformations": {
        "make": [{"rule": "normalize_case", "params": {"case": "title"}}, {"rule": "map_values", "params": {"mappings": {"Brand#1": "FIRST", "Brand#2": "SECOND"}}}],
        "model": [{"rule": "normalize_case", "params": {"case": "upper"}}, {"rule": "remove_extra_spaces"}, {"rule": "standardize_model_names"}],
        "year": [{"rule": "validate_range", "params": {"min": 1980, "max": 2030}}, {"rule": "convert_to_int"}],
        "coverage": [{"rule": "map_values", "params": {"mappings": {"todo riesgo": "TODO RIESGO", "robo": "ROBO"}}}],
    },
    "validations": {
        "required_fields": ["make", "year", "coverage"],
        "data_quality": [{"rule": "no_empty_strings", "fields": ["make", "model"]}, {"rule": "known_coverage_types", "field": "coverage", "params": {"allowed_values": ["TODO RIESGO", "COLISION", "ROBO"]}}],
    },
    "error_handling": {"on_validation_error": "warn", "on_transformation_error": "warn", "required_field_missing": "skip"},
}
_COVER = "['todo riesgo', 'COLISION', 'robo', 'vida', ''][(p_partkey % 5 + 1)::INT]"


@register(f"""
WITH l AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN 'only one' WHEN p_partkey % 13 = 0 THEN p_brand || ',' || p_name || ',abc,robo'
  ELSE lower(p_brand) || ', ' || replace(p_name, ' ', '   ') || ' ,' || (1960 + p_size * 2) || ',' || {_COVER} END AS line, p_partkey % 17 = 0 OR p_partkey % 13 = 0 AS bad, p_brand, p_name, 1960 + p_size * 2 AS y, nullif({_COVER}, '') AS c FROM part),
s AS (SELECT k, bad, line, CASE WHEN NOT bad THEN CASE p_brand WHEN 'Brand#1' THEN 'FIRST' WHEN 'Brand#2' THEN 'SECOND' ELSE p_brand END END AS make, CASE WHEN NOT bad THEN upper(p_name) END AS model, CASE WHEN NOT bad THEN y::VARCHAR END AS year, CASE WHEN NOT bad THEN CASE c WHEN 'todo riesgo' THEN 'TODO RIESGO' WHEN 'robo' THEN 'ROBO' ELSE c END END AS coverage FROM l)
SELECT k, make, model, year, coverage, CASE WHEN bad THEN 'corrupt' WHEN coverage IS NULL THEN 'skipped' ELSE 'kept' END AS outcome, CASE WHEN bad THEN 'corrupt=' || line
  ELSE array_to_string(list_filter([CASE WHEN year::INT NOT BETWEEN 1980 AND 2030 THEN 'year validate_range=' || year END, CASE WHEN coverage IS NULL THEN 'coverage required' END, CASE WHEN coverage = 'vida' THEN 'coverage known_coverage_types=vida' END], lambda x: x IS NOT NULL), ';') END AS found FROM s
""")
def row_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a sheet by a schema and a profile: kept rows with their errors, and those that are skipped or didn't parse."""
    k = F.col("p_partkey")
    cover = F.element_at(F.array(*map(F.lit, ("todo riesgo", "COLISION", "robo", "vida", ""))), (k % 5 + 1).cast("int"))
    fine = F.concat(F.lower("p_brand"), F.lit(", "), F.replace("p_name", F.lit(" "), F.lit("   ")), F.lit(" ,"), (1960 + F.col("p_size") * 2).cast("string"), F.lit(","), cover)
    line = F.when(k % 17 == 0, "only one").when(k % 13 == 0, F.concat("p_brand", F.lit(","), "p_name", F.lit(",abc,robo"))).otherwise(fine)
    parsed = F.from_csv(line, f"make string, model string, year int, coverage string, {U.CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": U.CORRUPT})
    sheet = table(spark, sf_dir, "part").select(k.alias("k"), parsed.alias("r")).select("k", "r.*")
    field = lambda c: F.when(F.col(U.CORRUPT).isNull(), F.col(c)).alias(c)  # noqa: E731  what was read of a corrupt row counts for nothing
    kept, aside = U.split(U.apply_rules(sheet.select("k", *(field(c) for c in ("make", "model", "year", "coverage")), U.CORRUPT), PROFILE))
    shown = F.array_join(F.transform(U.ERRORS, lambda e: F.concat_ws("=", F.concat_ws(" ", e["field"], e["rule"]), e["value"])), ";")
    return kept.unionByName(aside).select("k", "make", "model", "year", "coverage", U.OUTCOME, shown.alias("found"))


@register("""
SELECT p_partkey, p_name, CASE WHEN p_partkey % 21 = 0 THEN 'last ' || p_brand WHEN p_partkey % 7 = 0 THEN 'changed' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 21 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part
UNION ALL SELECT -1 - p_partkey, NULL, 'added', 1.0 FROM part WHERE p_partkey % 50 = 0
""")
def row_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows after two updates by key, the second of which adds rows; of several changes to a key the latest counts."""
    part, path = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice"), f"{work_dir(spark)}/table"
    V.create(part, path, ["p_partkey"], 16)
    change = lambda where, brand, price, at: part.where(where).select("p_partkey", F.lit(brand).alias("p_brand") if isinstance(brand, str) else brand.alias("p_brand"), price.cast("double").alias("p_retailprice"), F.lit(at).alias("at"))
    changes = change("p_partkey % 7 = 0", "changed", F.col("p_retailprice") * 2, 1).unionByName(change("p_partkey % 21 = 0", F.concat(F.lit("last "), "p_brand"), F.lit(None), 2))
    one = changes.groupBy("p_partkey").agg(F.max_by(F.struct("p_brand", "p_retailprice"), "at").alias("c")).select("p_partkey", "c.*")
    V.update(spark, path, one, ["p_partkey"])
    added = part.where("p_partkey % 50 = 0").select((-1 - F.col("p_partkey")).alias("p_partkey"), F.lit("added").alias("p_brand"), F.lit(1.0).alias("p_retailprice"))
    V.update(spark, path, added, ["p_partkey"], insert=True)
    return V.read(spark, path)


@register("""
WITH c AS (SELECT l_orderkey AS o_orderkey, arg_max(CASE WHEN l_returnflag <> 'N' THEN 'code-' || l_partkey END, (l_shipdate, l_linenumber, l_partkey)) AS to_code FROM (SELECT * FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'N') GROUP BY 1)
SELECT o_orderkey, coalesce(to_code, 'code-' || o_custkey) AS code FROM orders LEFT JOIN c USING (o_orderkey)
""")
def corrected_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes with the latest manual correction in place of the suggested one."""
    code = lambda c: F.concat(F.lit("code-"), F.col(c).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", code("o_custkey").alias("code"))
    made = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' and l_returnflag <> 'N'").select(F.col("l_orderkey").alias("o_orderkey"), code("l_partkey").alias("to_code"), "l_shipdate", "l_linenumber", "l_partkey")
    return V.overlay(rows, made, ["o_orderkey"], "code", "to_code", F.struct("l_shipdate", "l_linenumber", "l_partkey"))


@register("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET 5000")
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 200 of the rows, the latest first: counts by range find it, and only its range is sorted."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return G.page(rows, "l_shipdate", [F.asc("l_orderkey"), F.asc("l_linenumber")], 5000, 25, descending=True)


@register(f"""
WITH d AS (SELECT score, code = query_id AS hit FROM ({contract.oracle_sql()["queue_match"]})),
t AS (SELECT i / 100 AS threshold, (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM d WHERE floor(round(score * 100, 6)) >= i) AS accepted, (SELECT count(*) FROM d WHERE hit AND floor(round(score * 100, 6)) >= i) AS hits FROM range(101) r(i)),
p AS (SELECT *, round(hits / greatest(accepted, 1), 6) AS precision, bool_and(accepted = 0 OR hits / accepted >= 0.4) OVER (ORDER BY threshold DESC) AS good FROM t)
SELECT threshold, n, accepted, round(accepted / greatest(n, 1), 6) AS rate, precision, coalesce(threshold = (SELECT min(threshold) FROM p WHERE good AND accepted > 0), false) AS recommended FROM p
""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each threshold of automatic acceptance gives for the simple matcher, and the one to recommend."""
    scored = contract.queue_match(spark, sf_dir).select("score", (F.col("code") == F.col("query_id")).alias("hit"))
    return G.threshold_sweep(scored, "score", "hit", precision=0.4)
