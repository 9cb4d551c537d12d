"""Queries of attribute merging, row checks and tables of mails, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import attributes as A
from tessera.functions import values as V
from tessera.functions.html import html_tables
from tessera.operators import checks as C
from tessera.operators import profile as P
from tessera.plans import records as R
from tessera.plans.contract import register, spread, table

FUELS, BODIES = ("TDI", "nafta", "STEAM", ""), ("dc", "SUV", "van")
_pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
_pick_sql = lambda words, n: "[" + ", ".join(f"'{w}'" for w in words) + f"][({n} % {len(words)} + 1)::INT]"
#: Fixed values, apart from the code's own tables.
_FUEL = "CASE upper({x}) WHEN 'DIESEL' THEN 'DIESEL' WHEN 'TD' THEN 'DIESEL' WHEN 'TDI' THEN 'DIESEL' WHEN 'GASOLINA' THEN 'GASOLINE' WHEN 'GASOLINE' THEN 'GASOLINE' WHEN 'GAS' THEN 'GASOLINE' WHEN 'NAFTA' THEN 'GASOLINE' ELSE nullif({x}, '') END"
_BODY = "CASE upper({x}) WHEN 'DC' THEN 'DOUBLE_CAB' WHEN 'SUV' THEN 'SUV' ELSE nullif({x}, '') END"


@register(f"""
WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 <> 0 THEN p_brand WHEN p_partkey % 6 = 0 THEN '' END AS xb, CASE WHEN p_partkey % 4 = 0 THEN 1850 + p_size * 5 END AS xy, CASE WHEN p_partkey % 2 = 0 THEN 0.8 ELSE 0.0 END AS xc,
  CASE WHEN p_partkey % 5 <> 0 THEN {_pick_sql(FUELS, "p_partkey")} END AS mf, CASE WHEN p_partkey % 7 = 0 THEN 'model brand' END AS mb, p_partkey % 12 / 10.0 AS mc, p_name AS rm, 1990 + p_size AS ry, {_pick_sql(BODIES, "p_partkey")} AS rbody, (p_partkey % 9)::INT AS rd FROM part),
m AS (SELECT *, coalesce(nullif(xb, ''), mb) AS brand, coalesce(xy, ry) AS year, nullif(mf, '') AS fuel, nullif(rd, 0) AS doors FROM s)
SELECT k, brand, rm AS model, year, {_FUEL.format(x="fuel")} AS fuel, {_BODY.format(x="rbody")} AS body, doors, round(((brand IS NOT NULL)::INT + 1 + 1 + (fuel IS NOT NULL)::INT + 1) / 10.0, 6)::DOUBLE AS completeness,
  round(CASE WHEN xc > 0 THEN xc * 0.7 + mc * 0.3 ELSE mc END, 6)::DOUBLE AS confidence,
  concat_ws(',', CASE WHEN brand IS NOT NULL THEN 'has_core_attributes' END, CASE WHEN xc > 0 THEN 'has_excel_data' END, 'has_enhanced_attributes', CASE WHEN year BETWEEN 1900 AND 2030 THEN 'year_valid' END, 'fuel_type_normalized', 'drivetrain_normalized', 'body_style_normalized') AS checks,
  concat_ws('; ', CASE WHEN year NOT BETWEEN 1900 AND 2030 THEN 'Invalid year: ' || year END, CASE WHEN doors NOT BETWEEN 2 AND 6 THEN 'Invalid doors: ' || doors END, CASE WHEN mc > 1 THEN 'LLM confidence must be between 0.0 and 1.0: ' || mc::DOUBLE END) AS errors FROM m
""")
def attribute_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of a sheet, of a model's reading and of rules as one, with completeness, confidence, checks and invariants."""
    k, none = F.col("p_partkey"), lambda t: F.lit(None).cast(t)

    def source(**own: Column) -> Column:
        return F.struct(*(own.get(f, none(t)).alias(f) for f, t in A.FIELDS.items()))

    excel = source(brand=F.when(k % 3 != 0, F.col("p_brand")).when(k % 6 == 0, ""), year=F.when(k % 4 == 0, 1850 + F.col("p_size") * 5))
    model = source(fuel=F.when(k % 5 != 0, _pick(FUELS, k)), brand=F.when(k % 7 == 0, "model brand"))
    rule = source(model=F.col("p_name"), year=1990 + F.col("p_size"), body=_pick(BODIES, k), doors=(k % 9).cast("int"))
    xc, mc = F.when(k % 2 == 0, 0.8).otherwise(0.0), k % 12 / 10.0
    a = F.col("a")
    held = F.map_keys(F.map_filter(A.checks(a, F.col("xc")), lambda _, v: v))
    return table(spark, sf_dir, "part").select(k.alias("k"), A.merged(excel, model, rule).alias("a"), xc.alias("xc"), mc.alias("mc")).select(
        "k", "a.brand", "a.model", "a.year", A.code(a["fuel"], A.FUEL_CODES).alias("fuel"), A.code(a["body"], A.BODY_CODES).alias("body"), "a.doors", F.round(A.completeness(a), 6).alias("completeness"),
        F.round(A.overall_confidence(a, F.col("xc"), F.col("mc")), 6).alias("confidence"), F.array_join(held, ",").alias("checks"), F.array_join(A.invariant_errors(a, F.col("xc"), F.col("mc")), "; ").alias("errors"),
    )


VINS = ("3N1CK3CD8JL254182", "3N1CK3CD8JL25418", "3N1CK3CD8JL25418O", "")


@register(f"""
WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 8 <> 0 THEN {_pick_sql(VINS, "p_partkey")} END AS vin, CASE WHEN p_partkey % 8 <> 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '1850' WHEN 2 THEN '2040' WHEN 3 THEN '' ELSE '2019' END END AS y, CASE WHEN p_partkey % 8 <> 0 THEN CASE p_partkey % 6 WHEN 0 THEN 'AB' WHEN 1 THEN 'n/a' ELSE 'ABC123' END END AS plate FROM part)
SELECT k, CASE WHEN coalesce(vin, '') = '' AND coalesce(y, '') = '' AND coalesce(plate, '') = '' THEN 'Row is completely empty' ELSE concat_ws('; ',
  CASE WHEN vin <> '' AND length(vin) <> 17 THEN 'VIN must be 17 characters' WHEN regexp_matches(vin, '[IOQ]') THEN 'VIN contains I, O or Q' END, CASE y WHEN 'abc' THEN 'Invalid year format: abc' WHEN '1850' THEN 'Year 1850 is too old (minimum: 1900)' WHEN '2040' THEN 'Year 2040 is in the future' END,
  CASE WHEN length(plate) < 3 THEN 'License plate length unusual: ' || length(plate) || ' characters' END, CASE WHEN plate = 'n/a' THEN 'Invalid license plate: n/a' END) END AS errors FROM r
""")
def extracted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of extracted rows, empty ones first."""
    k = F.col("p_partkey")
    on = lambda c: F.when(k % 8 != 0, c)
    year = F.when(k % 5 == 0, "abc").when(k % 5 == 1, "1850").when(k % 5 == 2, "2040").when(k % 5 == 3, "").otherwise("2019")
    plate = F.when(k % 6 == 0, "AB").when(k % 6 == 1, "n/a").otherwise("ABC123")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), on(_pick(VINS, k)).alias("vin"), on(year).alias("model_year"), on(plate).alias("license_plate"))
    return rows.select("k", F.array_join(C.extracted_errors(rows, ["vin", "model_year", "license_plate"], 2025), "; ").alias("errors"))


@register(f"""
WITH r AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS marca, repeat(p_name, (p_partkey % 14)::INT) AS modelo, CASE WHEN p_partkey % 7 = 0 THEN '20x' ELSE (1930 + p_size * 2)::VARCHAR END AS y, {_pick_sql(VINS, "p_partkey")} AS vin,
  CASE WHEN p_partkey % 5 = 0 THEN '12 USD' ELSE '$1,000' END AS limite, CASE p_partkey % 4 WHEN 0 THEN '0.1234' WHEN 1 THEN '1.5' WHEN 2 THEN 'x' ELSE '0.5' END AS score, CASE WHEN p_partkey % 3 = 0 THEN 'yes' ELSE 'TRUE' END AS reviewed FROM part)
SELECT k, concat_ws('; ', CASE WHEN marca IS NULL THEN 'MARCA is required' END, CASE WHEN modelo = '' THEN 'MODELO is required' WHEN length(trim(modelo)) > 100 THEN 'MODELO must be at most 100 characters' END,
  CASE WHEN y = '20x' THEN 'AÑO must be a valid number' WHEN y::INT < 1980 THEN 'AÑO must be at least 1980' WHEN y::INT > 2030 THEN 'AÑO must be at most 2030' END, CASE WHEN y = '20x' THEN 'AÑO must be of type integer' END,
  CASE WHEN vin <> '' AND NOT regexp_matches(vin, '^[A-HJ-NPR-Z0-9]{{17}}$') THEN 'VIN does not match required pattern' END, 'COBERTURA is required', CASE WHEN limite = '12 USD' THEN 'LIMITE must be of type currency' END,
  CASE WHEN score = 'x' THEN 'SCORE must be a valid number' WHEN score = '1.5' THEN 'SCORE must be at most 1.0' END, CASE WHEN score = 'x' THEN 'SCORE must be of type decimal' END, CASE WHEN score = '0.1234' THEN 'SCORE must have at most 3 decimals' END, CASE WHEN reviewed = 'yes' THEN 'REVIEWED must be of type boolean' END) AS errors FROM r
""")
def template_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of export rows under the template's columns."""
    k = F.col("p_partkey")
    score = F.when(k % 4 == 0, "0.1234").when(k % 4 == 1, "1.5").when(k % 4 == 2, "x").otherwise("0.5")
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 9 != 0, F.col("p_brand")).alias("MARCA"), F.expr("repeat(p_name, cast(p_partkey % 14 as int))").alias("MODELO"), F.when(k % 7 == 0, "20x").otherwise((1930 + F.col("p_size") * 2).cast("string")).alias("AÑO"), _pick(VINS, k).alias("VIN"),
        F.when(k % 5 == 0, "12 USD").otherwise("$1,000").alias("LIMITE"), F.lit("c").alias("CVEGS"), score.alias("SCORE"), F.when(k % 3 == 0, "yes").otherwise("TRUE").alias("REVIEWED"),
    )
    return rows.select("k", F.array_join(C.template_errors(rows), "; ").alias("errors"))


@register(f"""
WITH r AS (SELECT p_partkey AS k, lower({_pick_sql(VINS, "p_partkey")}) AS vin, CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END AS description, p_brand AS brand, CASE WHEN p_partkey % 5 = 0 THEN '2200' ELSE '2019' END AS y, 'ab ' || p_partkey AS plate, CASE WHEN p_partkey % 4 = 0 THEN 'mx' ELSE 'mxn' END AS currency, CASE WHEN p_partkey % 7 = 0 THEN '-1' END AS insured,
  CASE p_partkey % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-02-30' END AS a, CASE WHEN p_partkey % 9 < 5 THEN '2024-01-01' ELSE '2025-01-01' END AS b FROM part)
SELECT k, upper(vin) AS vin, 'AB' || k AS license_plate, upper(currency) AS currency, concat_ws('; ', CASE WHEN vin = '' THEN 'vin is required' WHEN length(vin) < 17 THEN 'vin must be at least 17 characters' END, CASE WHEN description = '' THEN 'description is required' END, CASE WHEN y = '2200' THEN 'model_year must be at most 2100' END,
  CASE WHEN insured = '-1' THEN 'insured_value must be at least 0' END, CASE WHEN currency = 'mx' THEN 'currency must be at least 3 characters' END, CASE WHEN NOT regexp_matches(upper(vin), '^[A-HJ-NPR-Z0-9]{{17}}$') THEN 'VIN must be 17 alphanumeric characters (excluding I, O, Q)' END,
  CASE WHEN a = '2024-02-30' THEN 'policy_start must be a date' END, CASE WHEN a = '2024-01-01' AND b = '2024-01-01' THEN 'Policy end date must be after start date' END) AS errors FROM r
""")
def canonical_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical vehicle's fields in their form, and what breaks its rules."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("k"), F.lower(_pick(VINS, k)).alias("vin"), F.when(k % 6 == 0, "").otherwise(F.col("p_type")).alias("description"), F.col("p_brand").alias("brand"), F.when(k % 5 == 0, "2200").otherwise("2019").alias("model_year"), F.concat(F.lit("ab "), k.cast("string")).alias("license_plate"),
        F.when(k % 4 == 0, "mx").otherwise("mxn").alias("currency"), F.when(k % 7 == 0, "-1").alias("insured_value"), F.when(k % 3 == 0, "2024-01-01").when(k % 3 == 1, "2024-02-30").alias("policy_start"), F.when(k % 9 < 5, "2024-01-01").otherwise("2025-01-01").alias("policy_end"),
    )
    return C.canonical(rows).select("k", "vin", "license_plate", "currency", F.array_join("errors", "; ").alias("errors"))


@register(f"WITH {R.PROFILE_SQL} SELECT 'year_range' AS rule, k AS row_index FROM f WHERE year_range UNION ALL SELECT 'kind_enum', k FROM f WHERE kind_enum")
def profile_broken_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that break each rule of the profile."""
    return C.broken_rows(P.apply_profile(R.sheet(table(spark, sf_dir, "part")), R.PROFILE)[0], "k", ["year_range", "kind_enum"])


@register("""
WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s FROM customer)
SELECT k, CASE WHEN k % 7 = 0 THEN 0 ELSE CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END END AS n_tables, CASE WHEN k % 7 = 0 THEN '' ELSE 'No|Vehículo;1|' || n || ' & ' || s || CASE WHEN k % 3 = 0 THEN 'in<ner|in<ner;in<ner' ELSE '' END || ';2|Ford Fiesta 2012' || CASE WHEN k % 3 = 0 THEN '#in<ner' ELSE '' END END AS cells,
  CASE WHEN k % 7 = 0 THEN '' ELSE 'FORD FIESTA 2012' END AS vehicles FROM c
""")
def html_mail_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of HTML mails as rows of cells, one inside another among them, and the vehicles that the first one names."""
    k = F.col("c_custkey")
    inner = F.when(k % 3 == 0, "<table><tr><td> in&lt;ner </td></tr></table>").otherwise("")
    whole = F.concat(
        F.lit("<p>x<br><!-- <table><tr><td>no</td></tr></table> --><table border=1><tr><th>No</th><th><b> Veh&iacute;culo</b></th></tr><tr></tr><tr><td>1</td><td>"), F.col("c_name"), F.lit(" &amp; "), F.col("c_mktsegment"), inner,
        F.lit("</td></tr></td><tr><td>2</td><td> <script>x()</script><i>Ford Fiesta 2012</i></td></tr></table><table><tr></tr></table>"),
    )
    html = F.when(k % 7 == 0, "<p>nothing</p>").otherwise(whole)
    t = spread(table(spark, sf_dir, "customer"), "c_custkey").select(k.alias("k"), html_tables(html).alias("t"))
    cells = F.array_join(F.transform("t", lambda x: F.array_join(F.transform(x["rows"], lambda r: F.array_join(r, "|")), ";")), "#")
    first = F.when(F.size("t") > 0, F.array_join(V.table_vehicles(F.col("t")[0]["rows"]), "|")).otherwise("")
    return t.select("k", F.size("t").alias("n_tables"), cells.alias("cells"), first.alias("vehicles"))
