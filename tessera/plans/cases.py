"""Queries of the steps around the match and their SQL, side by side. Stand-ins as in contract.py and records.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import vehicle as H
from tessera.operators import cases as C
from tessera.plans import records as R
from tessera.plans.contract import catalogue, register, table


@register("""
WITH f AS (SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN 'a.CSV' WHEN 1 THEN 'b.exe' WHEN 2 THEN '' WHEN 3 THEN 'dir.x/c' WHEN 4 THEN 'd.xlsx' ELSE 'e.tar.pdf' END AS name, p_partkey * 20000 AS size FROM part)
SELECT k, CASE WHEN name = '' THEN 'No filename provided' WHEN name = 'b.exe' THEN 'File type .exe not allowed. Supported: .csv, .pdf, .xls, .xlsx' WHEN name = 'dir.x/c' THEN 'File type  not allowed. Supported: .csv, .pdf, .xls, .xlsx' WHEN size > 20971520 THEN 'File size ' || size || ' bytes exceeds maximum 20971520 bytes' END AS error FROM f
""")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that may be uploaded, and why others may not."""
    k = F.col("p_partkey")
    name = F.when(k % 6 == 0, "a.CSV").when(k % 6 == 1, "b.exe").when(k % 6 == 2, "").when(k % 6 == 3, "dir.x/c").when(k % 6 == 4, "d.xlsx").otherwise("e.tar.pdf")
    return table(spark, sf_dir, "part").select(k.alias("k"), C.upload_error(name, k * 20000).alias("error"))


@register(f"""
WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS b, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS m, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1990 + p_size END AS y, p_type || ' 4x4' AS d FROM part)
SELECT k, concat_ws(' ', {R._expanded_sql("b")}, nullif({R._expanded_sql("m")}, ''), nullif(y, 0), {R._expanded_sql("d")}) AS label, trim(concat_ws(' ', b, nullif(m, ''), nullif(y, 0), d)) AS query_text FROM s
""")
def match_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and query text of each record."""
    k = F.col("p_partkey")
    s = table(spark, sf_dir, "part").select(k.alias("k"), F.when(k % 4 != 0, F.col("p_brand")).alias("b"), F.when(k % 5 == 0, "").otherwise(F.col("p_name")).alias("m"), F.when(k % 3 == 0, 0).otherwise(1990 + F.col("p_size")).alias("y"), F.concat("p_type", F.lit(" 4x4")).alias("d"))
    return s.select("k", C.label(F.col("b"), F.col("m"), F.col("y"), F.col("d")).alias("label"), C.query_text(F.col("b"), F.col("m"), F.nullif(F.col("y"), F.lit(0)), F.col("d")).alias("query_text"))


@register("SELECT p_partkey AS k, 'S' || p_partkey AS vin, p_brand AS brand, (1990 + p_size)::VARCHAR AS model_year, p_type AS coverage FROM part")
def second_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical fields by the second table of synonyms, where `serie` is claimed twice and `modelo` is the year."""
    k = F.col("p_partkey")
    sheet = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("S"), k.cast("string")).alias(" Serie"), F.col("p_brand").alias("MARCA"), (1990 + F.col("p_size")).cast("string").alias("Modelo"), F.col("p_type").alias("paquete"))
    return sheet.withColumnsRenamed(C.synonyms_of(sheet.columns)).select("k", "vin", "brand", "model_year", "coverage")


@register("SELECT DISTINCT l_partkey AS code, p_brand AS brand, p_name AS model, 1990 + p_size AS year FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45")
def code_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the codes that are asked for."""
    asked = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("code"))
    return C.by_code(catalogue(table(spark, sf_dir, "part")), asked).drop("description")


@register("""
WITH q AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN upper(p_brand) END AS b, CASE WHEN p_partkey % 4 <> 0 THEN substr(p_name, 2, 5) ELSE '' END AS m, CASE WHEN p_partkey % 5 <> 0 THEN 1990 + p_size END AS y FROM part WHERE p_partkey % 20 = 0),
r AS (SELECT k, p_partkey AS code, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS rank FROM q JOIN part ON (b IS NULL OR contains(lower(p_brand), lower(b))) AND (m = '' OR contains(lower(p_name), lower(m))) AND (y IS NULL OR 1990 + p_size = y) WHERE b IS NOT NULL OR m <> '')
SELECT * FROM r WHERE rank <= 50
""")
def contains_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that hold a record's brand and model anywhere, of its year, for every record whose id is divisible by 20."""
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    q = part.where("p_partkey % 20 = 0").select(k.alias("k"), F.when(k % 3 != 0, F.upper("p_brand")).alias("brand"), F.when(k % 4 != 0, F.substring("p_name", 2, 5)).otherwise("").alias("model"), F.when(k % 5 != 0, 1990 + F.col("p_size")).alias("year"))
    return C.find_like(q, "k", catalogue(part)).withColumn("rank", F.col("rank").cast("long"))


_CANDIDATES_SQL = """
c AS (SELECT l_orderkey AS q, p_partkey AS code, CASE WHEN l_linenumber % 3 <> 0 THEN p_brand END AS brand, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE p_name END AS model, CASE WHEN l_quantity > 20 THEN 1990 + p_size END AS year, CASE WHEN l_linenumber % 5 <> 0 THEN p_type || repeat(' x', (l_quantity % 7)::INT) END AS description, l_linenumber AS n, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("q"), F.col("p_partkey").alias("code"), F.when(n % 3 != 0, F.col("p_brand")).alias("brand"), F.when(n % 4 == 0, "").otherwise(F.col("p_name")).alias("model"), F.when(F.col("l_quantity") > 20, 1990 + F.col("p_size")).alias("year"), F.when(n % 5 != 0, F.concat("p_type", F.expr("repeat(' x', cast(l_quantity % 7 as int))"))).alias("description"), n.alias("n"), "l_suppkey")


@register(f"""WITH {_CANDIDATES_SQL}, s AS (SELECT *, CASE WHEN brand <> '' THEN 30 ELSE 0 END + CASE WHEN model <> '' THEN 30 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN len(description) > 10 THEN 20 ELSE 0 END AS s FROM c)
SELECT q, count(*) AS total, count(*) FILTER (brand <> '' AND model <> '') AS valid, count(year) AS with_year, count(DISTINCT nullif(brand, '')) AS brands, round(avg(s) / 100, 6) AS quality, count(*) FILTER (s >= 80) AS high, count(*) FILTER (s >= 50 AND s < 80) AS medium, count(*) FILTER (s < 50) AS low FROM s GROUP BY q""")
def candidate_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the candidates of each query are like."""
    return C.diagnostics(_candidates(spark, sf_dir), "q")


@register(f"""WITH {_CANDIDATES_SQL}, d AS (SELECT DISTINCT l_suppkey AS q, code, model, year, description FROM c),
r AS (SELECT q, code, year, description, row_number() OVER (PARTITION BY q ORDER BY year IS NOT NULL DESC, len(description) DESC NULLS LAST, CASE WHEN description IS NULL THEN -1 ELSE len(list_filter(list_distinct(string_split(upper(description), ' ')), lambda x: x <> '')) END DESC, code, year, description) AS rank FROM d)
SELECT q, code, rank FROM r WHERE rank <= 10""")
def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten candidates of each query that go on."""
    c = _candidates(spark, sf_dir).select(F.col("l_suppkey").alias("q"), "code", "model", "year", "description").distinct()
    return C.capped(c, "q", 10).select("q", "code", F.col("rank").cast("long").alias("rank"))


_TEXT = "p_type || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'diesel' WHEN 1 THEN 'TDI 4wd' WHEN 2 THEN 'awd suv sport' ELSE '' END"
_Q = "CASE l_linenumber % 5 WHEN 0 THEN 'DIESEL' WHEN 1 THEN 'GASOLINE' END AS fuel, CASE l_linenumber % 3 WHEN 0 THEN '4X4' WHEN 1 THEN 'awd' END AS drivetrain, CASE WHEN l_linenumber % 2 = 0 THEN 'SUV' END AS body, CASE WHEN l_linenumber % 7 = 0 THEN 'Sport' END AS trim"


@register(f"""
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 <> 0 THEN lower(p_brand) END AS qb, CASE WHEN l_linenumber % 3 = 0 THEN 'zz' WHEN l_linenumber % 3 = 1 THEN substr(p_name, 1, 3) END AS qm, CASE WHEN l_quantity > 10 THEN 1990 + p_size + (l_quantity % 5)::INT END AS qy, {_Q},
  p_brand AS eb, p_name AS em, CASE WHEN l_suppkey % 5 <> 0 THEN 1990 + p_size END AS ey, {_TEXT} AS d FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT *, CASE WHEN qb IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN qm IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN qy IS NOT NULL AND ey IS NOT NULL THEN 2 ELSE 0 END + (fuel IS NOT NULL)::INT + (drivetrain IS NOT NULL)::INT AS w,
  CASE WHEN upper(qb) = upper(eb) THEN 3 ELSE 0 END + CASE WHEN contains(upper(em), upper(qm)) THEN 3 ELSE 0 END + CASE WHEN qy = ey THEN 2 ELSE 0 END + coalesce(contains(upper(d), upper(fuel)), false)::INT + coalesce(contains(upper(d), upper(drivetrain)), false)::INT AS h FROM m),
f AS (SELECT *, round(CASE WHEN w = 0 THEN 0.0 ELSE h / w END, 6)::DOUBLE AS score FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, score, concat_ws(',', CASE WHEN upper(qb) = upper(eb) THEN 'brand_match' END, CASE WHEN contains(upper(em), upper(qm)) THEN 'model_match' END, CASE WHEN qy = ey THEN 'year_match' END, CASE WHEN {R._allows_sql("fuel", "d", H.FUEL_VARIANTS)} THEN 'fuel_match' END,
  CASE WHEN {R._allows_sql("drivetrain", "d", H.DRIVETRAIN_VARIANTS)} THEN 'drivetrain_match' END, CASE WHEN {R._allows_sql("body", "d", H.BODY_VARIANTS)} THEN 'body_match' END, CASE WHEN trim IS NULL OR contains(upper(d), upper(trim)) THEN 'trim_match' END) AS flags,
  concat_ws('; ', CASE WHEN score < 0.6 THEN 'Low confidence match - manual review recommended' END, CASE WHEN qb IS NULL OR qm IS NULL OR qy IS NULL THEN 'Incomplete vehicle attributes - brand, model, or year missing' END, CASE WHEN abs(qy - ey) > 2 THEN 'Year mismatch: input ' || qy || ' vs matched ' || ey END, CASE WHEN ey IS NULL THEN 'Matched entry has incomplete year data' END) AS warnings FROM f
""")
def match_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted score, map of flags and warnings of records with their entries."""
    n, y = F.col("l_linenumber"), 1990 + F.col("p_size")
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    text = F.concat("p_type", F.lit(" "), F.when(F.col("p_partkey") % 4 == 0, "diesel").when(F.col("p_partkey") % 4 == 1, "TDI 4wd").when(F.col("p_partkey") % 4 == 2, "awd suv sport").otherwise(""))
    m = j.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(n % 4 != 0, F.lower("p_brand")).alias("qb"), F.when(n % 3 == 0, "zz").when(n % 3 == 1, F.substring("p_name", 1, 3)).alias("qm"), F.when(F.col("l_quantity") > 10, y + (F.col("l_quantity") % 5).cast("int")).alias("qy"), F.when(n % 5 == 0, "DIESEL").when(n % 5 == 1, "GASOLINE").alias("fuel"),
        F.when(n % 3 == 0, "4X4").when(n % 3 == 1, "awd").alias("drivetrain"), F.when(n % 2 == 0, "SUV").alias("body"), F.when(n % 7 == 0, "Sport").alias("trim"), F.col("p_brand").alias("eb"), F.col("p_name").alias("em"), F.when(F.col("l_suppkey") % 5 != 0, y).alias("ey"), text.alias("d"),
    )
    q = {"brand": F.col("qb"), "model": F.col("qm"), "year": F.col("qy")} | {c: F.col(c) for c in ("fuel", "drivetrain", "body", "trim")}
    e, d = {"brand": F.col("eb"), "model": F.col("em"), "year": F.col("ey")}, F.col("d")
    score = F.round(C.weighted_score(q, e, d), 6)
    core = F.col("qb").isNotNull() & F.col("qm").isNotNull() & F.col("qy").isNotNull()
    flags = F.array_join(F.map_keys(F.map_filter(C.match_map(q, e, d), lambda _, v: v)), ",")
    return m.select("l_orderkey", "l_linenumber", "l_partkey", score.alias("score"), flags.alias("flags"), F.array_join(C.match_warnings(score, core, F.col("qy"), F.col("ey")), "; ").alias("warnings"))


@register("""
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN 'I choose 2.' WHEN 1 THEN ' Option 3 of 9' WHEN 2 THEN 'none' WHEN 3 THEN '9 then 1' WHEN 4 THEN '0' END AS reply, (o_custkey % 4)::INT AS n FROM orders)
SELECT k, (CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN n >= 2 THEN 1 END WHEN 1 THEN CASE WHEN n >= 3 THEN 2 END WHEN 3 THEN CASE WHEN n >= 1 THEN 0 END END)::INT AS chosen FROM r JOIN orders ON o_orderkey = k
""")
def reply_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The option that a model's reply names among those it had."""
    k = F.col("o_orderkey")
    reply = F.when(k % 6 == 0, "I choose 2.").when(k % 6 == 1, " Option 3 of 9").when(k % 6 == 2, "none").when(k % 6 == 3, "9 then 1").when(k % 6 == 4, "0")
    return table(spark, sf_dir, "orders").select(k.alias("k"), C.chosen_option(reply, (F.col("o_custkey") % 4).cast("int")).alias("chosen"))


@register("""
WITH r AS (SELECT l_suppkey AS run_id, CASE WHEN l_returnflag = 'A' THEN 'auto_accept' WHEN l_returnflag = 'R' THEN 'needs_review' WHEN l_linenumber % 2 = 0 THEN 'no_match' END AS d, CASE WHEN l_quantity > 48 THEN 'x' END AS fix FROM lineitem)
SELECT run_id, count(*) AS rows_total, count(*) FILTER (d = 'auto_accept' AND fix IS NULL) AS rows_auto_accepted, count(*) FILTER (fix IS NOT NULL OR d = 'needs_review') AS rows_reviewed, count(*) FILTER (fix IS NULL AND coalesce(d, 'no_match') = 'no_match') AS rows_unresolved FROM r GROUP BY 1
""")
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export says of each run's rows."""
    flag = F.col("l_returnflag")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.when(flag == "A", "auto_accept").when(flag == "R", "needs_review").when(F.col("l_linenumber") % 2 == 0, "no_match").alias("d"), F.when(F.col("l_quantity") > 48, "x").alias("fix"))
    return C.export_summary(rows, "run_id", "d", "fix")


@register("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 50 AS chunk FROM orders")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a batch in chunks of fifty, with their place."""
    return C.chunks(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.asc("o_orderdate"), F.asc("o_orderkey")]).drop("o_orderdate")


@register("""
WITH m AS (SELECT o_orderkey AS mail, CASE WHEN o_orderkey % 3 = 0 THEN 'Client ' || o_custkey WHEN o_orderkey % 3 = 1 THEN ' ' END AS client_name, CASE WHEN o_orderkey % 4 = 0 THEN 'b@x.y' END AS broker_email, NULL AS broker_name, 's' || o_custkey || '@z' AS from_email, CASE WHEN o_orderkey % 5 <> 0 THEN 'Sender' END AS from_name FROM orders),
a AS (SELECT l_orderkey AS mail, min_by('Att ' || l_suppkey, (l_linenumber, l_suppkey)) FILTER (l_returnflag = 'A') AS c, min_by('Broker ' || l_suppkey, (l_linenumber, l_suppkey)) FILTER (l_returnflag = 'R') AS b FROM lineitem GROUP BY 1)
SELECT mail, coalesce(nullif(trim(client_name), ''), c) AS client_name, coalesce(broker_email, from_email) AS broker_email, coalesce(from_name, b) AS broker_name FROM m LEFT JOIN a USING (mail)
""")
def case_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case of each mail and its attachments, what the mail says first."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    mails = table(spark, sf_dir, "orders").select(
        k.alias("mail"), F.when(k % 3 == 0, F.concat(F.lit("Client "), F.col("o_custkey").cast("string"))).when(k % 3 == 1, " ").alias("client_name"), F.when(k % 4 == 0, "b@x.y").alias("broker_email"), none.alias("broker_name"),
        F.concat(F.lit("s"), F.col("o_custkey").cast("string"), F.lit("@z")).alias("from_email"), F.when(k % 5 != 0, "Sender").alias("from_name"),
    )
    named = lambda flag, word: F.when(F.col("l_returnflag") == flag, F.concat(F.lit(word), F.col("l_suppkey").cast("string")))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mail"), named("A", "Att ").alias("client_name"), named("R", "Broker ").alias("broker_name"), none.alias("broker_email"), F.struct("l_linenumber", "l_suppkey").alias("place"))
    return C.assembled_case(mails, parts, "mail", ["client_name", "broker_email", "broker_name"], "place")


@register("""
WITH m AS (SELECT CASE WHEN event_id % 50 <> 0 THEN user_id END AS id, event_type AS folder FROM events), k AS (SELECT o_custkey AS id, bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
SELECT folder, count(*) AS total, count(*) FILTER (id IS NOT NULL AND NOT coalesce(done, false)) AS processed, count(*) FILTER (done) AS skipped, count(*) FILTER (id IS NULL) AS errors FROM m LEFT JOIN k USING (id) GROUP BY folder
""")
def folder_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each folder that are queued again, left out as processed, or without an id."""
    messages = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("id"), F.col("event_type").alias("folder"))
    known = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "PROCESSED").otherwise("NEW").alias("status"))
    return C.catch_up(messages, known, "id", "status")[1]


@register("""
WITH r AS (SELECT user_id AS case_id, event_id AS run_id, CASE event_type WHEN 'purchase' THEN 'TRANSFORM' WHEN 'view' THEN 'CODIFY' ELSE 'EXTRACT' END AS component, event_id % 3 <> 0 AS ok, event_id % 4 <> 0 AS ready, ts AS tm FROM events),
t AS (SELECT case_id, max((tm, run_id)) FILTER (component = 'TRANSFORM' AND ok AND ready) AS t, max(tm) FILTER (component = 'CODIFY') AS c FROM r GROUP BY 1)
SELECT sha256(case_id || '/' || run_id) AS msg_id, case_id, run_id, 'CODIFY' AS component, '{"run_id":' || run_id || ',"case_id":' || case_id || ',"triggered_by":"api"}' AS payload FROM r JOIN t USING (case_id) WHERE component = 'TRANSFORM' AND ok AND ready AND (tm, run_id) = t AND (c IS NULL OR c < tm)
""")
def codify_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that start the match of cases whose transform is ready."""
    kind, n = F.col("event_type"), F.col("event_id")
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), n.alias("run_id"), F.when(kind == "purchase", "TRANSFORM").when(kind == "view", "CODIFY").otherwise("EXTRACT").alias("component"), F.when(n % 3 != 0, "SUCCESS").otherwise("FAILED").alias("status"), (n % 4 != 0).alias("ready"), F.col("ts").alias("at"))
    return C.codify_triggers(runs)
