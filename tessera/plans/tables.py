"""Queries of tables, sources, exports and searches and their SQL, side by side. Stand-ins as in records.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fuzzy as Z
from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import profile as P
from tessera.operators import search as S
from tessera.plans.contract import DIRTY_SQL, _sim_sql, catalogue, dirty, register, table
from tessera.plans.records import VEHICLES_SQL, vehicles
from tessera.sources.files import work_dir
from tessera.streaming import stages

# ---- extraction, transformation, export ----------------------------------------------------------

SYNONYMS = {"brand": ("brand", "marca", "make", "fabricante"), "model": ("model", "modelo", "vehicle_model"), "model_year": ("year", "año", "model_year", "año_modelo", "anio"), "color": ("color", "colour")}


@register("""
WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN ' ' END AS marca, upper(p_brand) AS make, CASE WHEN p_partkey % 4 = 0 THEN 'N/A' ELSE p_name END AS modelo, (1990 + p_size)::VARCHAR AS anio FROM part)
SELECT k, coalesce(nullif(trim(marca), ''), nullif(trim(make), '')) AS brand, CASE WHEN modelo <> 'N/A' THEN modelo END AS model, anio AS model_year, NULL::VARCHAR AS color FROM s
""")
def header_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fields of a sheet: per row the first synonym that holds something, then cleaned."""
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(k.alias("K"), F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, " ").alias(" Marca"), F.upper("p_brand").alias("Make"), F.when(k % 4 == 0, "N/A").otherwise(F.col("p_name")).alias("MODELO"), (1990 + F.col("p_size")).cast("string").alias("Anio"))
    return P.extract(s, {"k": ("k",)} | SYNONYMS).withColumn("k", F.col("k").cast("long"))


MAPPING = {"vehicle_description": "descr", "vehicle_brand": "brand", "vehicle_year": "year_text", "license_plate": "plate", "insured_value": "value", "vin": "code"}


@register("""
WITH s AS (SELECT p_partkey AS k, ' ' || p_name || '  x ' AS descr, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE p_brand END AS brand, 'modelo ' || (1880 + p_partkey % 200) AS year_text, ' ab  ' || (p_partkey % 1000) || ' c' AS plate, '$' || (p_partkey % 5000) || ',' || (p_partkey % 90 + 10) AS value,
  repeat('a b', (p_partkey % 9)::INT) AS code FROM part),
t AS (SELECT k, trim(regexp_replace(descr, '\\s+', ' ', 'g')) AS vehicle_description, nullif(brand, 'n/a') AS vehicle_brand, TRY_CAST(nullif(regexp_extract(year_text, '\\b((?:19|20)[0-9]{2})\\b', 1), '') AS INT) AS y, upper(trim(regexp_replace(plate, '\\s+', ' ', 'g'))) AS license_plate,
  replace(regexp_replace(value, '[^0-9.,]', '', 'g'), ',', '.')::DOUBLE AS insured_value, nullif(upper(replace(code, ' ', '')), '') AS vin FROM s)
SELECT k, vehicle_description, vehicle_brand, CASE WHEN y BETWEEN 1900 AND 2025 THEN y END AS vehicle_year, license_plate, insured_value, vin,
  concat_ws('; ', CASE WHEN vin IS NULL THEN 'vin is required' WHEN length(vin) < 17 THEN 'vin must be at least 17 characters' END, CASE WHEN length(vin) > 17 THEN 'vin must be at most 17 characters' END) AS errors,
  nullif(concat_ws(' - ', vehicle_brand, vehicle_description), '') AS label FROM t
""")
def field_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target fields by their types, rules, and a joined field."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    s = table(spark, sf_dir, "part").select(
        k.alias("k"), F.concat(F.lit(" "), F.col("p_name"), F.lit("  x ")).alias("descr"), F.when(k % 5 == 0, "n/a").otherwise(F.col("p_brand")).alias("brand"), F.concat(F.lit("modelo "), text(1880 + k % 200)).alias("year_text"),
        F.concat(F.lit(" ab  "), text(k % 1000), F.lit(" c")).alias("plate"), F.concat(F.lit("$"), text(k % 5000), F.lit(","), text(k % 90 + 10)).alias("value"), F.repeat(F.lit("a b"), (k % 9).cast("int")).alias("code"))
    out = P.field_mapped(s.select("k", *MAPPING.values()), MAPPING, {"vin": {"required": True, "min_length": 17, "max_length": 17}}, {"label": (("vehicle_brand", "vehicle_description"), " - ")})
    return out.select("k", *MAPPING, F.array_join("validation_errors", "; ").alias("errors"), "label")


@register("""
SELECT o_orderkey AS "Row", coalesce(c_name, 'not_processed') AS "Client", TRY_CAST(o_totalprice AS DOUBLE) AS "Value", 100 * 0.01 * (o_orderkey % 10) / 100 AS "Share", o_orderdate::DATE AS "Date", NULL::VARCHAR AS "Missing"
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
""")
def template_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template's typed columns from nested rows joined with their result; rows without one are not_processed."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    rows = table(spark, sf_dir, "orders").join(c, "o_custkey", "left")
    nested = rows.select(F.col("o_orderkey").alias("row"), F.struct(F.coalesce("name", F.lit("not_processed")).alias("client"), F.col("o_totalprice").cast("string").alias("value")).alias("data"), F.concat((F.col("o_orderkey") % 10).cast("string"), F.lit("%")).alias("share"), F.to_date("o_orderdate").alias("date"))
    out = P.exported(nested, [("Row", "row", "text"), ("Client", "data.client", "text"), ("Value", "data.value", "float"), ("Share", "share", "percent"), ("Date", "date", "date"), ("Missing", "data.nothing.here", "text")])
    return out.withColumn("Row", F.col("Row").cast("long"))


@register("""
WITH r AS (SELECT l_orderkey AS run_id, l_linenumber AS i, CASE WHEN l_quantity < 5 THEN 'quantity too small' WHEN l_discount > 0.08 THEN 'discount out of range' END AS error FROM lineitem)
SELECT run_id, count(*) AS n_rows, count(error) AS n_errors, round(100.0 * (count(*) - count(error)) / count(*), 6) AS success_rate, count(error) = 0 AS ready_for_matching,
  coalesce(array_to_string(list_slice(list(i || ': ' || error ORDER BY i, error) FILTER (error IS NOT NULL), 1, 3), '; '), '') AS first_errors FROM r GROUP BY run_id
""")
def transform_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, errors, rate, readiness and the first errors in row order. Only the first few of each task's rows are kept."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("i"), F.when(F.col("l_quantity") < 5, "quantity too small").when(F.col("l_discount") > 0.08, "discount out of range").alias("error"))
    first = r.where("error is not null").withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("i", "error"))).where("n <= 3")
    first = first.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "error"))), lambda x: F.concat(x["i"].cast("string"), F.lit(": "), x["error"])), "; ").alias("first_errors"))
    n, bad = F.count(F.lit(1)), F.count("error")
    m = r.groupBy("run_id").agg(n.alias("n_rows"), bad.alias("n_errors"), F.round(100.0 * (n - bad) / n, 6).alias("success_rate"), (bad == 0).alias("ready_for_matching"))
    return m.join(first, "run_id", "left").withColumn("first_errors", F.coalesce("first_errors", F.lit("")))


@register("""
WITH d AS (SELECT p_name AS vin, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1)
SELECT 'duplicate' AS kind, vin AS what, n FROM d UNION ALL SELECT 'missing', concat_ws(', ', CASE WHEN p_partkey % 7 = 0 THEN 'vin' END, CASE WHEN p_partkey % 11 = 0 THEN 'brand' END), count(*) FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0 GROUP BY 2
""")
def export_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate keys and missing required fields before an export."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    twice = p.groupBy(F.col("p_name").alias("what")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lacks = p.select(F.concat_ws(", ", F.when(k % 7 == 0, "vin"), F.when(k % 11 == 0, "brand")).alias("what")).where("what <> ''").groupBy("what").agg(F.count(F.lit(1)).alias("n"))
    return twice.select(F.lit("duplicate").alias("kind"), "what", "n").unionByName(lacks.select(F.lit("missing").alias("kind"), "what", "n"))


@register("""
SELECT o_orderkey, 'raw/' || strftime(o_orderdate, '%Y/%m') || '/case-' || o_custkey || '/att-1-' || sha256(o_orderkey::VARCHAR) || '.pdf' AS key, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp,
  TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'no date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS parsed, o_orderdate::DATE + (o_custkey % 7 - 3)::INT > o_orderdate::DATE AS policy_ok FROM orders
""")
def storage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content-addressed keys, stamps, and dates read back where they are dates."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey").cast("string")
    key = F.concat(F.lit("raw/"), F.date_format(d, "yyyy/MM"), F.lit("/case-"), F.col("o_custkey").cast("string"), F.lit("/att-1-"), F.sha2(k, 256), F.lit(".pdf"))
    parsed = F.when(F.col("o_orderkey") % 3 == 0, "no date").otherwise(F.date_format(d, "yyyy-MM-dd")).try_cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key"), F.date_format(d, "yyyyMMdd_HHmmss").alias("stamp"), parsed.alias("parsed"), (F.date_add(d, (F.col("o_custkey") % 7 - 3).cast("int")) > F.to_date(d)).alias("policy_ok"))


@register("""
SELECT l_orderkey AS run_id, l_linenumber AS row_idx, CASE WHEN l_discount <= 0.04 THEN l_partkey END AS code, CASE WHEN l_discount <= 0.04 THEN round(1 - l_discount * 5, 6) ELSE 0.0 END AS confidence, coalesce(CASE WHEN l_tax > 0.06 THEN l_suppkey END, CASE WHEN l_discount <= 0.04 THEN l_partkey END) AS corrected FROM lineitem
""")
def codify_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are stored: a failure has no code and confidence 0; manual corrections lie over the codes."""
    ok = F.col("l_discount") <= 0.04
    code = F.when(ok, F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("row_idx"), code.alias("code"), F.when(ok, F.round(1 - F.col("l_discount") * 5, 6)).otherwise(0.0).alias("confidence"), F.coalesce(F.when(F.col("l_tax") > 0.06, F.col("l_suppkey")), code).alias("corrected"))


# ---- searches and joins --------------------------------------------------------------------------


@register(f"""
WITH {DIRTY_SQL}
SELECT query_id, count(*) AS n, min(code) AS first_code FROM q JOIN c ON upper(trim(q_brand)) = upper(trim(brand)) AND abs(q_year - year) BETWEEN 1 AND 2 AND year BETWEEN 1900 AND 2030 GROUP BY query_id
""")
def year_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the same brand one or two years off, by equality: each record asks for four years of counted entries."""
    parts = table(spark, sf_dir, "part")
    c = catalogue(parts).where("year between 1900 and 2030").groupBy(F.upper(F.trim("brand")).alias("b"), "year").agg(F.count(F.lit(1)).alias("m"), F.min("code").alias("code"))
    q = dirty(parts).where("q_year is not null").select("query_id", F.upper(F.trim("q_brand")).alias("b"), F.explode(F.array(*(F.col("q_year") + d for d in (-2, -1, 1, 2)))).alias("year"))
    return q.join(c, ["b", "year"]).groupBy("query_id").agg(F.sum("m").alias("n"), F.min("code").alias("first_code"))


@register(f"WITH {DIRTY_SQL} SELECT query_id, count(*) AS n, min(code) AS first_code FROM q JOIN c ON length(q_brand) > 3 AND left(upper(q_brand), 3) = left(upper(brand), 3) GROUP BY query_id")
def prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose brand begins alike, counted by prefix before they are joined."""
    parts = table(spark, sf_dir, "part")
    head = lambda c: F.substring(F.upper(c), 1, 3).alias("head")
    c = catalogue(parts).groupBy(head("brand")).agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("first_code"))
    return dirty(parts).where(F.length("q_brand") > 3).select("query_id", head("q_brand")).join(c, "head").drop("head")


@register(f"""
WITH {DIRTY_SQL},
p AS (SELECT query_id, code, q_year = year AS same_year FROM q JOIN c ON upper(trim(q_brand)) = upper(trim(brand)) WHERE ({_sim_sql("q_model", "model", 0.9)}) >= 0.6),
n AS (SELECT query_id, count(*) FILTER (same_year) AS by_year, count(*) AS by_brand, min(code) FILTER (same_year) AS first_year_code, min(code) AS first_brand_code FROM p GROUP BY 1)
SELECT query_id, CASE WHEN coalesce(by_year, 0) >= 5 THEN 'brand_year' WHEN coalesce(by_brand, 0) >= 5 THEN 'brand' ELSE 'relaxed' END AS strategy, CASE WHEN by_year >= 5 THEN by_year WHEN by_brand >= 5 THEN by_brand ELSE 0 END AS n,
  CASE WHEN by_year >= 5 THEN first_year_code WHEN by_brand >= 5 THEN first_brand_code END AS first_code FROM q LEFT JOIN n USING (query_id)
""")
def domain_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate ladder: five of brand, year and a similar model, else five of the brand, else relaxed. Entries are counted by
    brand, model and year first, so a record meets its brand's models, not its entries."""
    parts = table(spark, sf_dir, "part")
    c = catalogue(parts).groupBy(F.upper(F.trim("brand")).alias("b"), "model", "year").agg(F.count(F.lit(1)).alias("m"), F.min("code").alias("code"))
    models, q = c.select("b", "model").distinct(), dirty(parts).withColumn("b", F.upper(F.trim("q_brand")))
    near = q.select("b", "q_model").distinct().join(models, "b").where(T.similarity(F.col("q_model"), F.col("model"), 0.9) >= 0.6)
    by_year = near.join(c, ["b", "model"]).groupBy("b", "q_model", F.col("year").alias("q_year")).agg(F.sum("m").alias("by_year"), F.min("code").alias("year_code"))
    by_brand = near.join(c, ["b", "model"]).groupBy("b", "q_model").agg(F.sum("m").alias("by_brand"), F.min("code").alias("brand_code"))
    out = q.join(by_brand, ["b", "q_model"], "left").join(by_year, ["b", "q_model", "q_year"], "left")
    pick = lambda a, b, c: F.when(F.col("by_year") >= 5, a).when(F.col("by_brand") >= 5, b).otherwise(c)
    return out.select("query_id", pick("brand_year", "brand", "relaxed").alias("strategy"), pick(F.col("by_year"), F.col("by_brand"), F.lit(0)).alias("n"), pick(F.col("year_code"), F.col("brand_code"), F.lit(None)).alias("first_code"))


@register("""
SELECT p_partkey AS code, p_brand AS brand, p_name AS model, 1990 + p_size AS year FROM part WHERE upper(p_brand) LIKE 'BRAND#1%' AND 1990 + p_size BETWEEN 2000 AND 2010 AND contains(upper(p_name), 'RING')
""")
def catalogue_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by criteria: brand prefix, years, part of the model; other keys are ignored."""
    return S.find(catalogue(table(spark, sf_dir, "part")), {"brand_prefix": "brand#1", "year_range": (2000, 2010), "model_contains": "ring", "unknown": 1}).drop("description")


@register("""
WITH q AS (SELECT DISTINCT p_name AS model, 1990 + p_size AS year FROM part), r AS (SELECT q.model, q.year, p_partkey AS code, CASE WHEN p_name = q.model THEN 1 WHEN contains(p_name, q.model) THEN 2 ELSE 3 END AS tier FROM q JOIN part ON 1990 + p_size = q.year AND p_brand = 'Brand#3')
SELECT model, year, min(tier) AS tier, count(*) FILTER (tier = (SELECT min(tier) FROM r r2 WHERE r2.model = r.model AND r2.year = r.year)) AS n FROM r GROUP BY model, year
""")
def catalogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brand's entries of a year: of the same model, else those that hold it, else all."""
    p = table(spark, sf_dir, "part").withColumn("year", 1990 + F.col("p_size"))
    q = p.select(F.col("p_name").alias("model"), "year").distinct()
    e = p.where("p_brand = 'Brand#3'").groupBy("year", "p_name").agg(F.count(F.lit(1)).alias("m"))
    r = q.join(e, "year").withColumn("tier", F.when(F.col("p_name") == F.col("model"), 1).when(F.col("p_name").contains(F.col("model")), 2).otherwise(3))
    return r.groupBy("model", "year", "tier").agg(F.sum("m").alias("n")).groupBy("model", "year").agg(F.min(F.struct("tier", "n")).alias("b")).select("model", "year", "b.tier", "b.n")


@register("""
SELECT p_partkey AS code, upper(concat_ws(' ', p_brand, p_name, concat_ws(' ', p_type, p_name))) AS search_text, p_brand || '_' || (1990 + p_size) AS brand_year, len(list_distinct(list_filter(string_split(upper(concat_ws(' ', p_brand, p_name, p_type)), ' '), lambda w: length(w) > 1 AND regexp_matches(w, '^[A-Z0-9]+$')))) AS n_tokens,
  lower(concat_ws(' ', p_brand, p_name, 1990 + p_size, 'tipo', p_type)) AS embed_text FROM part
""")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search text, block key, distinct tokens and the text to embed, for each entry."""
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), (1990 + F.col("p_size")).alias("year"), F.concat_ws(" ", "p_type", "p_name").alias("description"), F.col("p_type").alias("kind"))
    return c.select("code", *(x.alias(n) for n, x in S.index(F.col("brand"), F.col("model"), F.col("year"), F.col("description"), F.col("kind")).items()))


@register("""
WITH a AS (SELECT * FROM (VALUES ('BRAND#1', 'Alpha'), ('BRAND#2', 'Beta'), ('BRAND#02', 'Beta')) t(alias, canonical))
SELECT p_partkey AS code, coalesce(canonical, p_brand) AS brand, coalesce((SELECT string_agg(alias, ',' ORDER BY alias) FROM a b WHERE b.canonical = a.canonical), '') AS aliases FROM part LEFT JOIN a ON upper(p_brand) = a.alias
""")
def alias_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical brands by alias, and all aliases of each; the alias list is configuration, a few hundred rows."""
    a = spark.createDataFrame([("BRAND#1", "Alpha"), ("BRAND#2", "Beta"), ("BRAND#02", "Beta")], "alias string, canonical string")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), "p_brand")
    return S.with_aliases(p, "p_brand", a).select("code", F.col("canonical").alias("brand"), F.array_join("aliases", ",").alias("aliases"))


@register("""
WITH e AS (SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@' || CASE c_nationkey % 4 WHEN 0 THEN 'acme.com' WHEN 1 THEN 'lucky.gas' ELSE 'mail.example' END AS sender FROM customer), r AS (SELECT * FROM (VALUES ('acme.com', 'acme', 0.95), ('lucky.gas', 'lucky', 0.9)) t(domain, profile, confidence))
SELECT c_custkey, split_part(sender, '@', 2) AS domain, coalesce(profile, 'generic') AS profile, coalesce(confidence, 0.0)::DOUBLE AS confidence, left(sender, 10) AS short FROM e LEFT JOIN r ON split_part(sender, '@', 2) = r.domain
""")
def profile_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of a sender by the domain of the address; the registry of profiles is configuration."""
    n = F.col("c_nationkey") % 4
    sender = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), F.when(n == 0, "acme.com").when(n == 1, "lucky.gas").otherwise("mail.example"))
    r = spark.createDataFrame([("acme.com", "acme", 0.95), ("lucky.gas", "lucky", 0.9)], "domain string, profile string, confidence double")
    e = table(spark, sf_dir, "customer").select("c_custkey", F.substring_index(sender, "@", -1).alias("domain"), F.substring(sender, 1, 10).alias("short"))
    return e.join(F.broadcast(r), "domain", "left").select("c_custkey", "domain", F.coalesce("profile", F.lit("generic")).alias("profile"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "short")


@register(f"""
WITH {VEHICLES_SQL}, w AS (SELECT k, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS ws FROM v),
y AS (SELECT k, list_filter(ws, lambda x: length(x) > 1) AS ws FROM w),
u AS (SELECT k, unnest(ws) AS t FROM y UNION ALL SELECT k, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM y),
f AS (SELECT k, t, count(*) AS tf FROM u GROUP BY ALL), d AS (SELECT t, count(*) AS df FROM f GROUP BY 1 ORDER BY sum(tf) DESC, t LIMIT 1000), n AS (SELECT count(*) AS n FROM v),
x AS (SELECT k, t, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS x FROM f JOIN d USING (t), n), l AS (SELECT k, sqrt(sum(x * x)) AS l FROM x GROUP BY k)
SELECT a.k, round(sum(a.x * b.x) / any_value(la.l * lb.l), 6) AS similarity FROM x a JOIN x b ON b.k = a.k + 1 AND b.t = a.t JOIN l la ON la.k = a.k JOIN l lb ON lb.k = a.k + 1 GROUP BY a.k
""")
def tfidf_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF cosine of each description with the next entry's, from document frequencies of the whole catalogue."""
    v = vehicles(table(spark, sf_dir, "part"))
    x = S.tfidf(v, "k", "text")
    pairs = v.select("k", (F.col("k") + 1).alias("other"))
    return S.tfidf_cosine(x, pairs, "k", "other").select("k", F.round("similarity", 6).alias("similarity"))


@register("""
SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS position, count(*) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) + 9 < count(*) OVER (PARTITION BY user_id) AS has_more FROM events QUALIFY position <= 10
""")
def page_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each user's events, newest first, with the whole count and whether more follow."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    n = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    page = e.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id"))).where("position <= 10")
    return page.join(n, "user_id").select("user_id", "event_id", "ts", F.col("position").cast("long").alias("position"), "total", (F.col("position") + 9 < F.col("total")).alias("has_more"))


@register("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN event_id % 5 = 0 THEN '{}' ELSE props END AS parsed, event_type IN ('click', 'view') AND TRY_CAST(json_extract_string(props, '$.k') AS INT) >= 50 AS valid FROM (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN 'no json' ELSE props END AS raw, CASE WHEN event_id % 5 <> 0 THEN props END AS props FROM events)
""")
def message_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages read by schema: a text that isn't JSON becomes {}, and is not valid."""
    e = table(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_id") % 5 == 0, "no json").otherwise(F.col("props")))
    k = F.get_json_object(F.coalesce(F.when(F.expr("try_parse_json(raw)").isNotNull(), F.col("raw")), F.lit("{}")), "$.k").try_cast("int")
    return e.select("event_id", k.alias("k"), F.when(F.expr("try_parse_json(raw)").isNotNull(), F.col("raw")).otherwise("{}").alias("parsed"), (F.col("event_type").isin("click", "view") & (k >= 50)).alias("valid"))


# ---- mails ---------------------------------------------------------------------------------------


def mails(customers: DataFrame) -> DataFrame:
    k, n = F.col("c_custkey"), F.upper(F.replace("c_name", F.lit("#"), F.lit(" ")))
    letters = F.translate(n, "0123456789", "ABCDEFGHIJ")
    year = (1990 + k % 40).cast("string")
    lines = F.when(k % 5 == 0, F.concat(F.lit("1. Toyota  Hilux "), year, F.lit(" diesel\n* TOYOTA hilux "), year, F.lit(" DIESEL\n2) Ford Ranger 2012\n"))).when(k % 5 == 1, "Toyota corto\n").otherwise("- nada\n")
    body = F.concat(F.when(k % 3 != 0, F.concat(F.lit("CLIENTE: "), letters)).otherwise("hola"), F.lit("\n"), F.when(k % 4 == 0, "RFC: ABC010203XY1").otherwise("sin dato"), F.lit("\n"), F.when(k % 8 != 3, "BROKER: ana  maria\n").otherwise(""), F.when(k % 9 != 4, F.concat(F.lit("CORREO: u"), k.cast("string"), F.lit("@x.com\n"))).otherwise(""), lines, F.when(k % 7 == 0, "SINIESTROS: NO").when(k % 7 == 1, "con siniestros").otherwise(""))
    return customers.select("c_custkey", F.when(k % 6 == 0, "Quote").when(k % 6 == 1, "Claim").when(k % 6 == 2, "renewal").otherwise("hello").alias("subject"), body.alias("body"))


MAILS_SQL = """
e AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Quote' WHEN 1 THEN 'Claim' WHEN 2 THEN 'renewal' ELSE 'hello' END AS subject,
  CASE WHEN c_custkey % 3 <> 0 THEN 'CLIENTE: ' || translate(upper(replace(c_name, '#', ' ')), '0123456789', 'ABCDEFGHIJ') ELSE 'hola' END || chr(10) || CASE WHEN c_custkey % 4 = 0 THEN 'RFC: ABC010203XY1' ELSE 'sin dato' END || chr(10) || CASE WHEN c_custkey % 8 <> 3 THEN 'BROKER: ana  maria' || chr(10) ELSE '' END || CASE WHEN c_custkey % 9 <> 4 THEN 'CORREO: u' || c_custkey || '@x.com' || chr(10) ELSE '' END
  || CASE c_custkey % 5 WHEN 0 THEN '1. Toyota  Hilux ' || (1990 + c_custkey % 40) || ' diesel' || chr(10) || '* TOYOTA hilux ' || (1990 + c_custkey % 40) || ' DIESEL' || chr(10) || '2) Ford Ranger 2012' || chr(10) WHEN 1 THEN 'Toyota corto' || chr(10) ELSE '- nada' || chr(10) END || CASE c_custkey % 7 WHEN 0 THEN 'SINIESTROS: NO' WHEN 1 THEN 'con siniestros' ELSE '' END AS body FROM customer)"""


def _title_sql(x: str) -> str:
    return f"array_to_string(list_transform(string_split(lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


@register(f"""WITH {MAILS_SQL}
SELECT c_custkey, {_title_sql("nullif(regexp_extract(body, '(?i)CLIENTE:[[:space:]]*([A-Z[:space:].]+)', 1), '')")} AS client_name, nullif(upper(regexp_extract(body, '(?i)RFC:\\s*([A-Za-z0-9]{{10,13}})', 1)), '') AS client_rfc, {_title_sql("nullif(regexp_extract(body, '(?i)BROKER:[[:space:]]*([A-Z[:space:].]+)', 1), '')")} AS broker_name,
  CASE WHEN c_custkey % 9 <> 4 THEN 'u' || c_custkey || '@x.com' END AS broker_email, CASE lower(subject) WHEN 'quote' THEN 'fleet_quote' WHEN 'claim' THEN 'claim_report' WHEN 'renewal' THEN CASE WHEN contains(upper(body), 'SINIESTRO') THEN 'claim_report' ELSE 'policy_renewal' END ELSE CASE WHEN contains(upper(body), 'SINIESTRO') THEN 'claim_report' ELSE 'general_inquiry' END END AS kind,
  CASE c_custkey % 7 WHEN 0 THEN 'NO' WHEN 1 THEN 'con siniestros' END AS losses FROM e""")
def mail_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client, broker, kind and losses of each mail."""
    m = mails(table(spark, sf_dir, "customer"))
    return m.select("c_custkey", *(c.alias(n) for n, c in V.mail_fields(F.col("body")).items()), V.mail_type(F.col("subject"), F.col("body")).alias("kind"), V.loss_history(F.col("body")).alias("losses"))


@register(f"WITH {MAILS_SQL} SELECT c_custkey, 'TOYOTA HILUX ' || (1990 + c_custkey % 40) || ' DIESEL' AS vehicle, 1 AS position FROM e WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'FORD RANGER 2012', 2 FROM e WHERE c_custkey % 5 = 0")
def mail_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a mail that look like vehicles, cleaned, each once in order."""
    return S.vehicle_lines(mails(table(spark, sf_dir, "customer")), "c_custkey", "body")


@register("""
SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_sha256, len(regexp_extract_all(lower(html), '<tr[ >]')) AS table_rows FROM pages
""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of pages without scripts, styles and tags, and how many table rows they hold."""
    h = F.col("html")
    bare = F.regexp_replace(F.regexp_replace(h, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.collapse(bare), 256).alias("text_sha256"), F.size(F.regexp_extract_all(F.lower(h), F.lit("<tr[ >]"), 0)).cast("long").alias("table_rows"))


@register()
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 of an embedding's similarity and 0.3 of the token-set ratio of a record's and an entry's words, and the fuzzy model ratio; no
    SQL has these ratios, so tests compare them with a plain dynamic program."""
    v = vehicles(table(spark, sf_dir, "part"))
    pairs = v.withColumn("code", F.col("k") + 1).join(v.select(F.col("k").alias("code"), F.col("text").alias("label")), "code")
    known = (F.col("k") % 100) / 100.0
    scored = pairs.select("k", "code", Z.token_set_ratio(F.lower("text"), F.lower("label")).alias("lexical"), Z.model_ratio(F.col("text"), F.col("label")).alias("model"), known.alias("embed"))
    return scored.select("k", "code", "lexical", "model", F.round(0.7 * F.col("embed") + 0.3 * F.col("lexical"), 6).alias("score"))


@register("""
SELECT event_id, user_id, event_type = 'error' AS failed, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'EXPORTED' END AS status, CASE WHEN event_type = 'error' THEN 1 ELSE 3 END AS stages FROM events
""")
def stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages through three streaming stages, extract, transform and export; a message that fails goes no further."""
    return stages.chain(spark, f"{sf_dir}/events.parquet", work_dir(spark))
