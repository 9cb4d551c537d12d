"""Every registered query of the codification engine and its SQL, side by side.

Stand-ins: the catalogue is `part` (code, brand, model, year 1990 + size), records are derived from it; rows of runs are
`lineitem`; runs and cases are `orders` and `customer`; messages are `events`; texts are `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import flow as L
from tessera.operators import matching as M
from tessera.operators.vectors import knn

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _REGISTRY[f.__name__] = f, sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by its key over some tasks for each core: a small file is one task, however much is made of its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


#: Rows of a part of a join whose parts are as many as its input asks for.
PART_ROWS = 1 << 20


def parts_for(*tables: DataFrame) -> int:
    """How many parts tables are dealt in so that one of them holds PART_ROWS rows on average; their rows are counted by the files' footers.
    Parts that the engine sizes by shuffled bytes hold ever more rows, as sorted keys are compressed well."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-sum(t.count() for t in tables) // PART_ROWS))


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _REGISTRY.items() if s}


def dirty(parts: DataFrame) -> DataFrame:
    """Records that a sender might write of the catalogue's entries: other case, other year, a missing word or year."""
    n = F.col("p_partkey")
    return parts.select(
        n.alias("query_id"), F.when(n % 3 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("q_brand"),
        F.when(n % 4 == 0, F.element_at(F.split("p_name", " "), 1)).when(n % 4 == 1, F.concat(F.col("p_name"), F.lit(" 4x4"))).otherwise(F.col("p_name")).alias("q_model"),
        F.when(n % 5 != 0, 1990 + F.col("p_size") + F.when(n % 11 == 0, 1).otherwise(0)).alias("q_year"),
    )


def catalogue(parts: DataFrame) -> DataFrame:
    return parts.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), (1990 + F.col("p_size")).alias("year"), F.concat_ws(" ", "p_type", "p_name").alias("description"))


DIRTY_SQL = """
q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) ELSE p_brand END AS q_brand,
  CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) WHEN p_partkey % 4 = 1 THEN p_name || ' 4x4' ELSE p_name END AS q_model,
  CASE WHEN p_partkey % 5 <> 0 THEN 1990 + p_size + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END END AS q_year FROM part),
c AS (SELECT p_partkey AS code, p_brand AS brand, p_name AS model, 1990 + p_size AS year FROM part)"""


#: Records with the catalogue's entries of their brand and year, or of their brand where there is none of that year.
PAIRS_SQL = DIRTY_SQL + """,
k AS (SELECT DISTINCT upper(trim(brand)) AS b, year FROM c),
p AS (SELECT q.*, c.* FROM q LEFT JOIN k ON upper(trim(q_brand)) = k.b AND q_year = k.year JOIN c ON upper(trim(q_brand)) = upper(trim(brand)) AND (k.b IS NULL OR c.year = q_year))"""


def _sim_sql(a: str, b: str, inside: float, boost: float = 1.0, most: float = 1.0) -> str:
    x, y = f"upper(trim({a}))", f"upper(trim({b}))"
    wa, wb = (f"list_filter(list_distinct(string_split_regex({v}, '\\s+')), lambda w: w <> '')" for v in (x, y))
    return f"""CASE WHEN {a} IS NULL OR {b} IS NULL OR {x} = '' OR {y} = '' THEN 0.0 WHEN {x} = {y} THEN 1.0
      WHEN contains({x}, {y}) OR contains({y}, {x}) THEN {inside}
      ELSE least({most}, len(list_intersect({wa}, {wb}))::DOUBLE / len(list_distinct(list_concat({wa}, {wb}))) * {boost}) END"""


@register(f"""
WITH {PAIRS_SQL},
s AS (SELECT query_id, code, 0.4 * ({_sim_sql("q_brand", "brand", 0.8)}) + 0.4 * ({_sim_sql("q_model", "model", 0.8)}) + CASE WHEN q_year = year THEN 0.2 ELSE 0.0 END AS s FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, code) AS rn FROM s)
SELECT query_id, code, round(s, 6) AS score, CASE WHEN round(s, 6) >= 0.9 THEN 'auto_accept' WHEN round(s, 6) >= 0.8 THEN 'needs_review' ELSE 'no_match' END AS decision FROM r WHERE rn = 1
""")
def queue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple matcher: block on brand and year, on brand alone where there is none of the year; weighted score, best code,
    decision. Scored on distinct keys and distinct models."""
    parts = table(spark, sf_dir, "part")
    records, keys, entries = dirty(parts), L.keys_of(dirty(parts)), L.entries_of(catalogue(parts))
    p = L.with_model_scores(L.candidates(keys, entries), keys, entries, sm=T.similarity(F.col("q_model"), F.col("model"), 0.8))
    score = F.round(0.4 * F.when(F.col("b") == "", 0.0).otherwise(1.0) + 0.4 * F.col("sm") + F.when(F.col("q_year") == F.col("year"), 0.2).otherwise(0.0), 6)
    best = p.groupBy(*L.KEY).agg(F.min(F.struct((-score).alias("s"), "code")).alias("best")).select(*L.KEY, F.col("best.code").alias("code"), (-F.col("best.s")).alias("score"))
    return L.back(records, best).where("code is not null").select("query_id", "code", "score", M.decide(F.col("score"), M.Thresholds(0.9, 0.8)).alias("decision"))


@register(f"""
WITH {PAIRS_SQL},
s AS (SELECT query_id, code, {_sim_sql("q_brand", "brand", 0.9, 1.2, 0.8)} AS sb, {_sim_sql("q_model", "model", 0.9)} AS sm,
  CASE WHEN q_year IS NULL THEN 0.0 WHEN abs(q_year - year) = 0 THEN 1.0 WHEN abs(q_year - year) = 1 THEN 0.9 WHEN abs(q_year - year) = 2 THEN 0.7 WHEN abs(q_year - year) <= 5 THEN 0.5 ELSE 0.1 END AS sy FROM p),
t AS (SELECT query_id, code, round(0.4 * sb + 0.35 * sm + 0.15 * sy + 0.1 * 0.5, 6) AS score FROM s),
r AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nx, max(score) OVER (PARTITION BY query_id) AS best FROM t WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, code))
SELECT query_id, max(best) AS best, round(max(CASE WHEN rn = 1 THEN score - nx END), 6) AS gap, count(*) FILTER (score >= best - 0.05) AS tied,
  CASE WHEN max(best) >= 0.85 THEN 'high' WHEN max(best) >= 0.65 THEN 'medium' WHEN max(best) >= 0.45 THEN 'low' ELSE 'very_low' END AS level
FROM r GROUP BY query_id
""")
def domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain matcher: component scores, gap to the runner-up, tie set, confidence level."""
    parts = table(spark, sf_dir, "part")
    records, keys, entries = dirty(parts), L.keys_of(dirty(parts)), L.entries_of(catalogue(parts))
    p = L.with_model_scores(L.candidates(keys, entries), keys, entries, sm=T.similarity(F.col("q_model"), F.col("model"), 0.9))
    score = F.round(0.4 * F.when(F.col("b") == "", 0.0).otherwise(1.0) + 0.35 * F.col("sm") + 0.15 * M.year_closeness(F.col("q_year"), F.col("year")) + F.lit(0.1) * 0.5, 6)
    flags = M.tie_flags(p.select(F.struct(*L.KEY).alias("key"), "n", score.alias("score")), "key", "score", "n").select("key.*", "best", "gap", "tied")
    return L.back(records, flags).where("best is not null").select("query_id", "best", F.round("gap", 6).alias("gap"), "tied", T.case_level(F.col("best"), 0.85, 0.65, 0.45).alias("level"))


@register(f"""
WITH {DIRTY_SQL},
p AS (SELECT query_id, code, CASE WHEN q_year = year AND model = q_model THEN 1 WHEN q_year = year THEN 2 ELSE 3 END AS tier FROM q JOIN c ON upper(trim(q_brand)) = upper(trim(brand))),
b AS (SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM p)
SELECT query_id, tier, count(*) AS n, min(code) AS first_code FROM b WHERE tier = best GROUP BY query_id, tier
""")
def block_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relaxation ladder: exact model of brand and year, brand and year, brand alone; the best tier of each query. Each tier
    is a join with counts by its key, so no pairs of a record and an entry exist."""
    parts = table(spark, sf_dir, "part")
    c = catalogue(parts).select("code", "model", "year", F.upper(F.trim("brand")).alias("b"))
    out = dirty(parts).withColumn("b", F.upper(F.trim("q_brand"))).withColumnsRenamed({"q_model": "model", "q_year": "year"})
    for tier, key in enumerate((["b", "year", "model"], ["b", "year"], ["b"]), 1):
        out = out.join(c.groupBy(*key).agg(F.struct(F.lit(tier).alias("tier"), F.count(F.lit(1)).alias("n"), F.min("code").alias("first_code")).alias(f"t{tier}")), key, "left")
    best = F.coalesce("t1", "t2", "t3")
    return out.where(best.isNotNull()).select("query_id", best["tier"].alias("tier"), best["n"].alias("n"), best["first_code"].alias("first_code"))


_PLAIN_SQL = f"translate(%s, '{T.ACCENTED}', '{T.PLAIN}')"


@register(f"""
WITH d AS (SELECT doc_id, text, {_PLAIN_SQL % "replace(replace(replace(replace(lower(trim(text)), 'ß', 'ss'), 'æ', 'ae'), 'ø', 'o'), 'œ', 'oe')"} AS x FROM documents),
n AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(regexp_replace(x, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9_\\s.\\-]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm,
  trim(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS descr FROM d)
SELECT doc_id, sha256(norm) AS norm_sha256, sha256(descr) AS descr_sha256,
  sha256(array_to_string(list_filter(string_split(descr, ' '), lambda w: w NOT IN ('DE', 'LA', 'EL', 'EN', 'CON', 'Y', 'O', 'DEL') AND length(w) > 1), ' ')) AS tokens_sha256 FROM n
""")
def text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"), T.clean_description(F.col("text")).alias("descr"), T.search_tokens(F.col("text")).alias("tokens"))
    return d.select("doc_id", F.sha2("norm", 256).alias("norm_sha256"), F.sha2("descr", 256).alias("descr_sha256"), F.sha2(F.array_join("tokens", " "), 256).alias("tokens_sha256"))


@register("""
WITH x AS (SELECT o_orderkey, 'modelo ' || (1850 + o_orderkey % 300)::VARCHAR || ' $' || round(o_totalprice, 2)::VARCHAR AS t, o_orderkey, (1390 + o_orderkey % 800)::VARCHAR AS code,
  '$' || (o_orderkey % 5000)::VARCHAR || ',' || (o_orderkey % 90 + 10)::VARCHAR AS money FROM orders)
SELECT o_orderkey, TRY_CAST(nullif(regexp_extract(t, '\\b((?:19|20)[0-9]{2})\\b', 1), '') AS INT) AS first_year,
  CASE WHEN TRY_CAST(code AS INT) BETWEEN 1900 AND 2099 THEN TRY_CAST(code AS INT) WHEN TRY_CAST(code AS INT) BETWEEN 1400 AND 1499 THEN TRY_CAST(code AS INT) + 600 END AS year_of_code,
  TRY_CAST(replace(regexp_replace(money, '[^0-9.,]', '', 'g'), ',', '.') AS DOUBLE) AS amount FROM x
""")
def years_and_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    price = F.round("o_totalprice", 2).cast("decimal(38,2)").cast("string")  # never with an exponent; two decimals cannot be a year
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("modelo "), (1850 + k % 300).cast("string"), F.lit(" $"), price).alias("t"), (1390 + k % 800).cast("string").alias("code"), F.concat(F.lit("$"), (k % 5000).cast("string"), F.lit(","), (k % 90 + 10).cast("string")).alias("money"))
    return o.select("o_orderkey", T.first_year(F.col("t")).alias("first_year"), T.year_code(F.col("code")).alias("year_of_code"), T.parse_currency(F.col("money")).alias("amount"))


@register("""
SELECT count(*) AS n_rows, count(*) FILTER (p_size % 7 <> 0) AS n_embedded, round(100.0 * count(*) FILTER (p_size % 7 <> 0) / count(*), 6) AS coverage, count(DISTINCT p_brand) AS n_brands,
  count(DISTINCT p_name) AS n_models, min(1990 + p_size) AS first_year, max(1990 + p_size) AS last_year FROM part
""")
def catalogue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    some = F.count_if(F.col("p_size") % 7 != 0)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), some.alias("n_embedded"), F.round(100.0 * some / F.count(F.lit(1)), 6).alias("coverage"), F.countDistinct("p_brand").alias("n_brands"),
                 F.countDistinct("p_name").alias("n_models"), (F.min("p_size") + 1990).alias("first_year"), (F.max("p_size") + 1990).alias("last_year"))


@register("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 10")
def top_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "brand").limit(10)


@register("SELECT 1990 + p_size AS year, count(*) AS n FROM part GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def recent_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy((1990 + F.col("p_size")).alias("year")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("year")).limit(10)


@register("SELECT DISTINCT p_brand AS brand, p_name AS model, 1990 + p_size AS year FROM part")
def brand_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), (1990 + F.col("p_size")).alias("year")).distinct()


@register("""
WITH r AS (SELECT l_orderkey AS run_id, l_linenumber AS row_index, 1 - l_discount * 5 AS score FROM lineitem)
SELECT run_id, count(*) AS total, count(*) FILTER (score >= 0.9) AS auto_accepted, count(*) FILTER (score >= 0.7 AND score < 0.9) AS reviewed, count(*) FILTER (score < 0.7) AS no_match,
  round(avg(CASE WHEN score > 0 THEN score END), 6) AS mean_score FROM r GROUP BY run_id
""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), (1 - F.col("l_discount") * 5).alias("score"))
    s = F.col("score")
    return r.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(s >= 0.9).alias("auto_accepted"), F.count_if((s >= 0.7) & (s < 0.9)).alias("reviewed"), F.count_if(s < 0.7).alias("no_match"), F.round(F.avg(F.when(s > 0, s)), 6).alias("mean_score"))


@register("""
SELECT o_custkey AS case_id, count(*) AS n_runs, CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'failed' WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'completed'
  WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'processing' ELSE 'pending' END AS status, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS progress FROM orders GROUP BY 1
""")
def case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, n, s = F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1)), F.col("o_orderstatus")
    status = F.when(F.count_if(s == "P") > 0, "failed").when(done == n, "completed").when(done > 0, "processing").otherwise("pending")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(n.alias("n_runs"), status.alias("status"), F.round(100.0 * done / n, 6).alias("progress"))


@register("""
SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN l_quantity < 5 THEN 'quantity too small' END, CASE WHEN l_quantity > 45 THEN 'quantity too large' END,
  CASE WHEN l_discount > 0.08 THEN 'discount out of range' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag not allowed' END], lambda x: x IS NOT NULL)::VARCHAR AS errors FROM lineitem
""")
def row_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.array_compact(F.array(
        F.when(F.col("l_quantity") < 5, "quantity too small"), F.when(F.col("l_quantity") > 45, "quantity too large"),
        F.when(F.col("l_discount") > 0.08, "discount out of range"), F.when(~F.coalesce(F.col("l_returnflag").isin("A", "N"), F.lit(False)), "flag not allowed")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("["), F.array_join(flags, ", "), F.lit("]")).alias("errors"))


@register("SELECT l_partkey AS vin, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("vin")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@register("""
SELECT c_custkey, count(*) FILTER (o_orderkey IS NOT NULL) AS n_cases, max(o_orderdate) AS last_case, coalesce(max_by(o_orderstatus, (o_orderdate, o_orderkey)), 'not_processed') AS status
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
""")
def email_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_case"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_cases"), "last_case", F.coalesce("s", F.lit("not_processed")).alias("status"))


@register("SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS processed FROM orders WHERE o_orderstatus <> 'P'")
def processed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed and unprocessed runs: a semi and an anti join with the rows that show it, in parts of a bounded size."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = parts_for(lines, orders)
    done = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).repartition(n, "o_orderkey")
    o = orders.where("o_orderstatus <> 'P'").select("o_orderkey").repartition(n, "o_orderkey")
    return o.join(done, "o_orderkey", "left_semi").withColumn("processed", F.lit(True)).unionByName(o.join(done, "o_orderkey", "left_anti").withColumn("processed", F.lit(False)))


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


@register("""
SELECT o_orderkey, 'TK-' || year(o_orderdate)::VARCHAR || '-' || lpad(row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderdate, o_orderkey)::VARCHAR, 6, '0') AS case_number FROM orders
""")
def case_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case numbers by year: numbered within each day, after the running count of the year's earlier days, so that no window
    holds more rows than a day's orders or a year's days."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.to_date("o_orderdate").alias("day"))
    year = Window.partitionBy(F.year("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = o.groupBy("day").agg(F.count(F.lit(1)).alias("n")).select("day", F.coalesce(F.sum("n").over(year), F.lit(0)).alias("earlier"))
    n = F.row_number().over(Window.partitionBy("day").orderBy("o_orderdate", "o_orderkey")) + F.col("earlier")
    return o.join(days, "day").select("o_orderkey", F.concat(F.lit("TK-"), F.year("day").cast("string"), F.lit("-"), F.lpad(n.cast("string"), 6, "0")).alias("case_number"))


@register("SELECT p_brand AS brand, p_name AS model, p_size AS size, min(p_partkey) AS code FROM part GROUP BY ALL")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("model"), F.col("p_size").alias("size")).agg(F.min("p_partkey").alias("code"))


@register("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@register("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_errors, max_by(event_type, (ts, event_id)) AS last_type, max(ts) AS last_ts FROM events GROUP BY user_id")
def event_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state machine's fold: the last status of each key."""
    e = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"), F.max_by("event_type", e).alias("last_type"), F.max("ts").alias("last_ts"))


@register("""
SELECT query_id, vec_id, similarity, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id) WHERE rank <= 25
""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine neighbours of every row whose id is divisible by 20, among all rows."""
    v = table(spark, sf_dir, "embeddings")
    return knn(v, v.where("vec_id % 20 = 0"), 25).withColumn("rank", F.col("rank").cast("long"))


@register(f"""
WITH {PAIRS_SQL},
s AS (SELECT query_id, code, 0.4 * ({_sim_sql("q_brand", "brand", 0.8)}) + 0.4 * ({_sim_sql("q_model", "model", 0.8)}) + CASE WHEN q_year = year THEN 0.2 ELSE 0.0 END AS s FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, code) AS rn FROM s),
d AS (SELECT query_id, code = query_id AS hit, CASE WHEN round(s, 6) >= 0.9 THEN 'auto_accept' WHEN round(s, 6) >= 0.8 THEN 'needs_review' ELSE 'no_match' END AS decision FROM r WHERE rn = 1)
SELECT count(*) AS n, round(avg(hit::INT), 6) AS top1_accuracy, round(count(*) FILTER (decision = 'auto_accept' AND hit) / greatest(count(*) FILTER (decision = 'auto_accept'), 1), 6) AS auto_precision,
  round(count(*) FILTER (decision = 'auto_accept') / count(*), 6) AS auto_rate, round(count(*) FILTER (decision = 'needs_review') / count(*), 6) AS review_rate, round(count(*) FILTER (decision = 'no_match') / count(*), 6) AS no_match_rate FROM d
""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple matcher's decisions against the truth, which is the entry that a record was written of."""
    d, hit = queue_match(spark, sf_dir), F.col("code") == F.col("query_id")
    n, of = F.count(F.lit(1)), lambda k: F.count_if(F.col("decision") == k)
    rate = lambda k: F.round(of(k) / n, 6)
    precision = F.round(F.count_if((F.col("decision") == "auto_accept") & hit) / F.greatest(of("auto_accept"), F.lit(1)), 6)
    return d.agg(n.alias("n"), F.round(F.avg(hit.cast("int")), 6).alias("top1_accuracy"), precision.alias("auto_precision"), rate("auto_accept").alias("auto_rate"), rate("needs_review").alias("review_rate"), rate("no_match").alias("no_match_rate"))


@register("""
WITH s AS (SELECT l_orderkey AS query_id, round(1 - l_discount * 5, 6) AS score FROM lineitem), b AS (SELECT query_id, max(score) AS best FROM s GROUP BY 1)
SELECT query_id, count(*) AS n, count(*) FILTER (round(best - score, 6) <= 0.01) AS strict_ties, count(*) FILTER (round(best - score, 6) <= 0.05) AS loose_ties,
  round(max(score) - min(score), 6) AS spread, round(stddev_pop(score), 6) AS deviation FROM s JOIN b USING (query_id) GROUP BY query_id
""")
def tie_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and loose ties with the best score of each query, spread and population deviation; the best is a window over the grouping's own shuffle."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.round(1 - F.col("l_discount") * 5, 6).alias("score"))
    behind = F.round(F.max("score").over(Window.partitionBy("query_id")) - F.col("score"), 6)
    return s.withColumn("behind", behind).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("behind") <= 0.01).alias("strict_ties"), F.count_if(F.col("behind") <= 0.05).alias("loose_ties"),
        F.round(F.max("score") - F.min("score"), 6).alias("spread"), F.round(F.stddev_pop("score"), 6).alias("deviation"),
    )


@register(f"""
WITH {DIRTY_SQL}
SELECT round(100.0 * count(q_brand) / count(*), 6) AS brand, round(100.0 * count(q_model) / count(*), 6) AS model, round(100.0 * count(q_year) / count(*), 6) AS year, count(q_year) AS with_year FROM q
""")
def column_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows with a value, for each column, in one pass."""
    share = lambda c: F.round(100.0 * F.count(c) / F.count(F.lit(1)), 6)
    return dirty(table(spark, sf_dir, "part")).agg(share("q_brand").alias("brand"), share("q_model").alias("model"), share("q_year").alias("year"), F.count("q_year").alias("with_year"))


@register("""
SELECT user_id AS case_id, max(ts) FILTER (event_type = 'signup') AS extract_at, max(ts) FILTER (event_type = 'view') AS transform_at, max(ts) FILTER (event_type = 'purchase') AS export_at,
  least(100, 30 * max((event_type = 'signup')::INT) + 40 * max((event_type = 'view')::INT) + 30 * max((event_type = 'purchase')::INT))::BIGINT AS progress FROM events GROUP BY 1
""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of a case as columns, and its weighted progress: 30 extract, 40 transform, 30 export."""
    kind = F.col("event_type")
    last = lambda k: F.max(F.when(kind == k, F.col("ts")))
    done = lambda k, w: F.max(F.when(kind == k, w).otherwise(0))
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id")).agg(
        last("signup").alias("extract_at"), last("view").alias("transform_at"), last("purchase").alias("export_at"),
        F.least(F.lit(100), done("signup", 30) + done("view", 40) + done("purchase", 30)).cast("long").alias("progress"),
    )
