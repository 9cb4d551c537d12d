"""Queries of searches, coverages, requests and screens and their SQL, side by side.

Stand-ins: entries are `part`; policy rows and mails with coverages are written from `orders`; vehicles of batch requests are
`lineitem` by supplier; vectors are `embeddings`, asked for by a mix of two of them; runs are `orders` and `events`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import coverage as C
from tessera.functions import values as V
from tessera.operators import requests as R
from tessera.operators.contains import description_search, text_search
from tessera.operators.vectors import ladder
from tessera.plans.contract import catalogue, register, table


def _pick(words: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def _pick_sql(words: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][({n} % {len(words)} + 1)::INT]"


@register("""
WITH c AS (SELECT min(p_partkey) AS code, upper(concat_ws(' ', p_brand, p_name, p_type, p_name, 1990 + p_size)) AS t FROM part GROUP BY p_brand, p_name, p_type, p_size),
q AS (SELECT p_partkey AS query_id, upper(CASE p_partkey // 20 % 4 WHEN 0 THEN p_name WHEN 1 THEN p_brand || ' ' || split_part(p_name, ' ', 2) WHEN 2 THEN substr(p_name, 2, 6) ELSE p_type || ' ' || (1990 + p_size) END) AS phrase FROM part WHERE p_partkey % 20 = 0),
w AS (SELECT *, list_filter(string_split_regex(phrase, '\\s+'), lambda x: x <> '') AS terms FROM q),
s AS (SELECT query_id, code, len(list_filter(terms, lambda x: contains(t, x))) + CASE WHEN contains(t, phrase) THEN len(terms) ELSE 0 END AS score FROM w, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS rank FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 100
""")
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by the terms of a text, for every record whose id is divisible by 20, among all entries."""
    part = table(spark, sf_dir, "part")
    entries = catalogue(part).groupBy("brand", "model", "description", "year").agg(F.min("code").alias("code")).select("code", F.concat_ws(" ", "brand", "model", "description", F.col("year").cast("string")).alias("t"))
    n = F.floor(F.col("p_partkey") / 20) % 4
    text = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat_ws(" ", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)))).when(n == 2, F.substring("p_name", 2, 6)).otherwise(F.concat_ws(" ", "p_type", (1990 + F.col("p_size")).cast("string")))
    asked = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), text.alias("phrase"))
    return text_search(asked, "query_id", "phrase", entries, "code", "t").withColumn("rank", F.col("rank").cast("long"))


@register("""
WITH c AS (SELECT p_partkey AS code, lower(concat_ws(' ', p_type, p_name, p_partkey)) AS t FROM part),
q AS (SELECT p_partkey AS query_id, lower(left(concat_ws(' ', p_type, p_name, p_partkey // 10), 50)) AS needle FROM part),
r AS (SELECT query_id, code, row_number() OVER (PARTITION BY query_id ORDER BY code) AS rank FROM q JOIN c ON contains(t, needle))
SELECT * FROM r WHERE rank <= 20
""")
def description_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose description contains the start of a record's."""
    part = table(spark, sf_dir, "part")
    text = lambda n: F.concat_ws(" ", "p_type", "p_name", n.cast("long").cast("string"))
    entries = part.select(F.col("p_partkey").alias("code"), text(F.col("p_partkey")).alias("t"))
    asked = part.select(F.col("p_partkey").alias("query_id"), text(F.floor(F.col("p_partkey") / 10)).alias("d"))
    return description_search(asked, "query_id", "d", entries, "code", "t").withColumn("rank", F.col("rank").cast("long"))


@register("""
WITH w AS (SELECT vec_id, embedding, label, CASE vec_id % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.8 ELSE 1.5 END::DOUBLE AS w FROM embeddings WHERE vec_id % 20 = 0),
q AS (SELECT -1 - w.vec_id AS query_id, list_transform(list_zip(w.embedding::DOUBLE[], n.embedding::DOUBLE[]), lambda z: z[1] + w.w * z[2]) AS e, CASE WHEN w.vec_id % 40 = 0 THEN w.label END AS want FROM w JOIN embeddings n ON n.vec_id = w.vec_id + 1),
s AS (SELECT query_id, v.vec_id, round(list_cosine_similarity(e, v.embedding::DOUBLE[]), 6) AS similarity FROM q JOIN embeddings v ON want IS NULL OR want = v.label),
m AS (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS best, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s),
f AS (SELECT *, CASE WHEN best >= 0.85 THEN 'high_similarity' WHEN best >= 0.7 THEN 'medium_similarity' ELSE 'low_similarity' END AS strategy FROM m
  WHERE rank <= 10 AND similarity >= CASE WHEN best >= 0.85 THEN 0.85 WHEN best >= 0.7 THEN 0.7 ELSE 0.5 END)
SELECT q.query_id, vec_id, similarity, rank, coalesce(strategy, 'no_match') AS strategy FROM q LEFT JOIN f USING (query_id)
""")
def vector_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a mix of two vectors among those of the label that it asks for, at the first of three thresholds that holds one."""
    v = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    weight = F.when(k % 3 == 0, 0.3).when(k % 3 == 1, 0.8).otherwise(1.5)
    after = v.select((k - 1).alias("vec_id"), F.col("embedding").alias("_next"))
    mixed = F.zip_with("embedding", "_next", lambda x, y: x.cast("double") + F.col("_w") * y.cast("double"))
    asked = v.where("vec_id % 20 = 0").withColumn("_w", weight).join(after, "vec_id").select((-1 - k).alias("vec_id"), mixed.alias("embedding"), F.when(k % 40 == 0, F.col("label")).alias("label"))
    return ladder(v, asked, 10, "label").withColumn("rank", F.col("rank").cast("long"))


WRITTEN = ("Comprehensive", "  todo   riesgo ", "RC", "terceros", "Hurto", "FIRE", "fuego", "natural disasters", "COMP", "uim", "granizo")
_NAMES = ", ".join(f"('{a}', '{n}')" for a, n in C.names().items())
_POLICY_SQL = f"""
p AS (SELECT o_orderkey, {_pick_sql(WRITTEN, "o_orderkey")} AS kind, CASE o_orderkey % 6 WHEN 0 THEN '$' || format('{{:,}}', (o_custkey % 500 + 1) * 1000) WHEN 1 THEN (o_custkey % 500 + 1) || ' USD' WHEN 2 THEN (o_custkey % 500 + 1) || 'K' WHEN 3 THEN (o_custkey % 500 + 1) || 'm' WHEN 4 THEN 'unlimited' END AS lim,
  CASE o_orderkey % 5 WHEN 0 THEN '500' WHEN 1 THEN '5%' WHEN 2 THEN '10000' WHEN 3 THEN '7%' END AS ded, o_custkey % 500 + 1 AS n FROM orders),
a AS (SELECT p.*, coalesce(name, 'UNKNOWN') AS coverage, CASE o_orderkey % 6 WHEN 0 THEN n * 1000 WHEN 1 THEN n WHEN 2 THEN n * 1000 WHEN 3 THEN n * 1000000 END AS amount
  FROM p LEFT JOIN (VALUES {_NAMES}) t(alias, name) ON alias = lower(trim(regexp_replace(kind, '\\s+', ' ', 'g'))))"""


@register(f"""WITH {_POLICY_SQL}
SELECT o_orderkey, coverage, amount, CASE WHEN amount IS NULL THEN 'TBD' ELSE '$' || format('{{:,}}', amount) END AS limit_text,
  CASE ded WHEN '500' THEN '$500' WHEN '10000' THEN '$10,000' WHEN '5%' THEN '5% of vehicle value' END AS deductible,
  coverage = 'UNKNOWN' OR amount IS NULL OR coalesce(try_cast(ded AS BIGINT) > amount, false) AS review FROM a
""")
def coverage_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard coverage, limit and deductible of each policy row, and whether it needs a review."""
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 500 + 1
    lim = F.when(k % 6 == 0, F.concat(F.lit("$"), F.format_number(n * 1000, 0))).when(k % 6 == 1, F.concat(n.cast("string"), F.lit(" USD"))).when(k % 6 == 2, F.concat(n.cast("string"), F.lit("K"))).when(k % 6 == 3, F.concat(n.cast("string"), F.lit("m"))).when(k % 6 == 4, "unlimited")
    ded = F.when(k % 5 == 0, "500").when(k % 5 == 1, "5%").when(k % 5 == 2, "10000").when(k % 5 == 3, "7%")
    p = table(spark, sf_dir, "orders").select("o_orderkey", _pick(WRITTEN, k).alias("kind"), lim.alias("lim"), ded.alias("ded"))
    return p.select("o_orderkey", C.coverage(F.col("kind")).alias("coverage"), C.limit_amount(F.col("lim")).alias("amount"), C.limit_text(F.col("lim")).alias("limit_text"), C.deductible_text(F.col("ded")).alias("deductible"), C.needs_review(F.col("kind"), F.col("lim"), F.col("ded")).alias("review"))


@register(f"""
WITH m AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Coverage: ' || {_pick_sql(WRITTEN, "o_orderkey")} || ' LIMIT: $' || o_custkey || ',000' || chr(10) || 'cobertura: robo límite: 50,000' || chr(10) || 'fin' WHEN 1 THEN 'COBERTURA: TODO RIESGO LIMITE: 5' WHEN 2 THEN 'sin dato' ELSE 'COVERAGE: firelimit: 7 y' END AS body FROM orders),
x AS (SELECT o_orderkey, regexp_extract_all(body, '(?i){C.PAIR}', 1) AS c, regexp_extract_all(body, '(?i){C.PAIR}', 2) AS l FROM m)
SELECT o_orderkey, len(c) AS n, array_to_string(list_transform(list_zip(c, l), lambda z: regexp_replace(z[1], '^\\s+|\\s+$', '', 'g') || '=' || regexp_replace(z[2], '^\\s+|\\s+$', '', 'g')), ';') AS pairs FROM x
""")
def mail_coverages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverages of mails with their limits, in the order of the text."""
    k = F.col("o_orderkey")
    two = F.concat(F.lit("Coverage: "), _pick(WRITTEN, k), F.lit(" LIMIT: $"), F.col("o_custkey").cast("string"), F.lit(",000\ncobertura: robo límite: 50,000\nfin"))
    body = F.when(k % 4 == 0, two).when(k % 4 == 1, "COBERTURA: TODO RIESGO LIMITE: 5").when(k % 4 == 2, "sin dato").otherwise("COVERAGE: firelimit: 7 y")
    found = table(spark, sf_dir, "orders").select("o_orderkey", C.coverage_pairs(body).alias("found"))
    return found.select("o_orderkey", F.size("found").cast("long").alias("n"), F.array_join(F.transform("found", lambda x: F.concat_ws("=", x["coverage"], x["limit"])), ";").alias("pairs"))


@register("""
SELECT c_custkey, array_to_string(list_filter([
  CASE WHEN c_custkey % 5 = 0 THEN 'TOYOTA HILUX ' || (1990 + c_custkey % 40) || ' DIESEL' END, CASE WHEN c_custkey % 3 = 1 AND c_custkey % 5 = 0 THEN 'HONDA CIVIC 2015' END, 'NISSAN MARCH MANUAL'], lambda x: x IS NOT NULL), '|') AS vehicles FROM customer
""")
def table_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicles of a mail's table: cells of the columns whose header names vehicles, of all columns where none does."""
    k = F.col("c_custkey")
    head = F.when(k % 3 == 0, F.array(F.lit("No"), F.lit("Vehículo"), F.lit("Nota"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("id"), F.lit("unidad asegurada"), F.lit("x")))
    one = F.when(k % 5 == 0, F.concat(F.lit("1. Toyota  Hilux "), (1990 + k % 40).cast("string"), F.lit(" diesel"))).otherwise("Toyota")
    other = F.when(k % 5 == 0, "Honda Civic 2015").otherwise("nada")
    rows = F.array(head, F.array(F.lit("1"), one, other), F.array(F.lit("2"), F.lit("- Nissan March manual")))
    return table(spark, sf_dir, "customer").select("c_custkey", rows.alias("rows")).select("c_custkey", F.array_join(V.table_vehicles(F.col("rows")), "|").alias("vehicles"))


@register("""
WITH v AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_orderkey % 97 = 0 THEN '' WHEN l_orderkey % 89 = 0 THEN 'abc' WHEN l_orderkey % 83 = 0 THEN repeat('x', 1001) ELSE 'vehicle ' || l_partkey END AS d,
  CASE WHEN l_orderkey % 101 <> 0 THEN 'i' END AS insurer, CASE WHEN l_orderkey % 10 = 0 THEN 1880 + l_linenumber * 25 END AS year, CASE WHEN l_orderkey % 50 = 0 THEN 'SHORT' END AS vin FROM lineitem),
e AS (SELECT l_suppkey, pos, list_filter([CASE WHEN d = '' THEN 'Vehicle description is required' END, CASE WHEN insurer IS NULL THEN 'Insurer ID is required' END, CASE WHEN len(d) > 1000 THEN 'Vehicle description too long (max 1000 characters)' END,
  CASE WHEN len(d) < 5 THEN 'Vehicle description too short (min 5 characters)' END, CASE WHEN year NOT BETWEEN 1900 AND 2030 THEN 'Invalid year: ' || year END, CASE WHEN vin IS NOT NULL THEN 'VIN format appears invalid' END], lambda x: x IS NOT NULL) AS errors FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY len(errors) = 0, pos) AS rn FROM e),
b AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (len(errors) > 0) AS n_invalid, string_agg('Vehicle ' || pos || ': ' || array_to_string(errors, '; '), ' | ' ORDER BY rn) FILTER (len(errors) > 0 AND rn <= 5) AS shown FROM r GROUP BY 1)
SELECT l_suppkey, n, n_invalid, concat_ws(' | ', CASE WHEN n > 600 THEN 'Batch size ' || n || ' exceeds maximum (600)' END, shown, CASE WHEN n_invalid > 5 THEN 'Additional ' || (n_invalid - 5) || ' vehicles have validation errors' END) AS messages FROM b
""")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and vehicles of batch requests, checked."""
    k = F.col("l_orderkey")
    d = F.when(k % 97 == 0, F.lit(None).cast("string")).when(k % 89 == 0, "abc").when(k % 83 == 0, "x" * 1001).otherwise(F.concat(F.lit("vehicle "), F.col("l_partkey").cast("string")))
    errors = R.vehicle_errors(d, F.when(k % 101 != 0, "i"), F.when(k % 10 == 0, 1880 + F.col("l_linenumber") * 25), F.when(k % 50 == 0, "SHORT"))
    vehicles = table(spark, sf_dir, "lineitem").select("l_suppkey", (k * 8 + F.col("l_linenumber")).alias("pos"), errors.alias("errors"))
    return R.batch_errors(vehicles, "l_suppkey", "pos", "errors", 600).withColumn("messages", F.array_join("messages", " | "))


@register("""
SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_codes, round(avg(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber / 10.0 ELSE 0 END) * 100, 1) AS average FROM lineitem GROUP BY 1
""")
def results_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen says of a run's results, added in the order of the table."""
    n = F.col("l_linenumber")
    results = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(n % 3 != 0, n / 10.0).alias("confidence"), F.when(F.col("l_returnflag") == "R", "code").when(F.col("l_returnflag") == "A", "").alias("code"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return R.results_summary(results, "l_orderkey", "confidence", "code", [F.col("file"), F.col("row")])


STATES = ("extracting", "transforming", "ready_for_matching", "matching", "completed", "error", "waiting")


@register(f"""
WITH s AS (SELECT user_id, arg_max({_pick_sql(STATES, "event_id")}, (ts, event_id)) AS status FROM events GROUP BY 1)
SELECT user_id, status, CASE status WHEN 'extracting' THEN 25 WHEN 'transforming' THEN 50 WHEN 'ready_for_matching' THEN 75 WHEN 'matching' THEN 90 WHEN 'completed' THEN 100 ELSE 0 END AS percent FROM s
""")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each run is, by its last status."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(_pick(STATES, F.col("event_id")), F.struct("ts", "event_id")).alias("status"))
    return last.withColumn("percent", R.stage_percent(F.col("status")))


@register("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent')")
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs whose name contains a text, the latest first."""
    return R.listed(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_orderkey", "URGENT", F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderdate", "o_orderpriority")
