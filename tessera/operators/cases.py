"""Small steps around the match: uploads, labels, lookups, diagnostics of candidates, summaries, replies of a model, cases of mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vehicle as H
from tessera.operators.matching import top_k
from tessera.operators.ordinals import numbered

# Fixed values that results depend on.
SUFFIXES, MOST_BYTES = (".csv", ".pdf", ".xls", ".xlsx"), 20 * 1024 * 1024
FIELD_SYNONYMS = {
    "vin": ("no_serie", "numero_serie", "n°_serie", "num_serie", "serie", "vin", "chasis", "no.chasis", "no_chasis", "serial_number"), "description": ("descripcion", "descripcion_vehiculo", "descripción", "detalle", "modelo_descripcion"),
    "brand": ("marca", "fabricante", "brand"), "model_year": ("modelo", "mod", "año", "anio", "modelo_serie", "year", "model_year"), "license_plate": ("placa", "serie", "placas", "matricula", "placas_vehiculo", "registration", "patente"),
    "subbrand": ("submarca", "linea", "versión", "version", "trim"), "unit_type": ("tipo_unidad", "tipo_de_unidad", "clase", "clase_vehiculo", "tipo_vehiculo", "body_type"), "use_type": ("uso", "uso_vehiculo", "uso_comercial", "service_use", "tipo_valor_uso"),
    "fuel_type": ("combustible", "tipo_combustible", "fuel"), "valuation_type": ("tipo_valor", "tipo_de_valor", "valor_tipo"), "insured_value": ("valor_vehiculo", "suma_asegurada", "valor", "valor_comercial", "valor_factura"), "currency": ("moneda", "divisa"),
    "coverage": ("paquete", "cobertura", "plan", "package"), "company_name": ("empresa", "razon_social", "cliente", "compañía"), "policy_start": ("vigencia_inicio", "inicio_vigencia", "fecha_inicio", "effective_date"), "policy_end": ("vigencia_fin", "fin_vigencia", "fecha_fin", "expiry_date"),
}


def upload_error(name: Column, size: Column) -> Column:
    """Why a file isn't taken, null where it is: no name, another suffix, more than 20 MB."""
    suffix = F.regexp_extract(F.lower(name), r"[^/.](\.[^./]*)$", 1)
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "No filename provided").when(~suffix.isin(*SUFFIXES), F.concat(F.lit("File type "), suffix, F.lit(" not allowed. Supported: " + ", ".join(SUFFIXES))))
        .when(size > MOST_BYTES, F.concat(F.lit("File size "), size.cast("string"), F.lit(f" bytes exceeds maximum {MOST_BYTES} bytes")))
    )


def synonyms_of(headers: list[str], synonyms: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """field by header, of those that are there; a header that two fields claim goes to the first of them."""
    out: dict[str, str] = {}
    for field, names in (synonyms or FIELD_SYNONYMS).items():
        for name in names:
            found = next((h for h in headers if h.strip().lower() == name), None)
            if found is not None and found not in out:
                out[found] = field
    return out


def label(brand: Column, model: Column, year: Column, *more: Column) -> Column:
    """Normalised parts in one text; null and empty parts and a year of 0 are left out."""
    words = [H.expanded(c) for c in (brand, model, *more)]
    return F.array_join(F.array_remove(F.array(*words[:2], F.nullif(year, F.lit(0)).cast("string"), *words[2:]), ""), " ")  # nulls aren't joined


def query_text(*parts: Column) -> Column:
    """Raw parts in one text; null and empty ones are left out."""
    return F.trim(F.concat_ws(" ", *(F.nullif(p.cast("string"), F.lit("")) for p in parts)))


def by_code(catalogue: DataFrame, asked: DataFrame, code: str = "code") -> DataFrame:
    """One entry for each code that is asked for and there."""
    own = catalogue.groupBy(code).agg(F.min(F.struct(*(c for c in catalogue.columns if c != code))).alias("_e"))
    return asked.select(code).distinct().join(own, code).select(code, "_e.*")


def find_like(queries: DataFrame, query: str, entries: DataFrame, k: int = 50) -> DataFrame:
    """(query, code): the k least codes of entries whose brand and model contain the query's and whose year is its year, where it has them.
    Letters of patterns stand for themselves. Distinct brands and models meet, entries after that."""
    from tessera.operators.contains import contains_join

    low = lambda df, *cols: df.withColumns({f"_{c}": F.lower(c) for c in cols})
    q, e = low(queries.select(query, "brand", "model", "year"), "brand", "model").drop("brand", "model"), low(entries.select("code", "brand", "model", F.col("year").alias("e_year")), "brand", "model").drop("brand", "model")
    groups = e.select(F.col("_brand").alias("e_brand"), F.col("_model").alias("e_model")).distinct()
    asked = q.where("_brand <> '' or _model <> ''").select("_brand", "_model").distinct()
    brands = contains_join(groups, "e_brand", asked, "_brand")
    models = contains_join(groups, "e_model", asked, "_model")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    both = asked.where(has("_brand") & has("_model")).join(brands, "_brand").join(models, "_model").join(groups, ["e_brand", "e_model"])
    one = asked.where(has("_brand") & ~has("_model")).join(brands, "_brand").join(groups, "e_brand")
    other = asked.where(has("_model") & ~has("_brand")).join(models, "_model").join(groups, "e_model")
    cols = ["_brand", "_model", "e_brand", "e_model"]
    met = both.select(*cols).unionByName(one.select(*cols)).unionByName(other.select(*cols)).withColumnsRenamed({"_brand": "b", "_model": "m"})
    # distinct demands meet distinct entries: the k entries with the least codes hold a demand's k least codes, at most k each
    year = F.coalesce("year", F.lit(0)).alias("year")
    demands = q.select("_brand", "_model", year).distinct()
    of_entry = e.select(F.col("_brand").alias("e_brand"), F.col("_model").alias("e_model"), "e_year", "code")
    kinds = of_entry.groupBy("e_brand", "e_model", "e_year").agg(F.min("code").alias("least"))
    near = demands.join(met, demands["_brand"].eqNullSafe(met["b"]) & demands["_model"].eqNullSafe(met["m"])).join(kinds.hint("merge"), ["e_brand", "e_model"])
    first = top_k(near.where((F.col("year") == 0) | (F.col("year") == F.col("e_year"))).withColumn("demand", F.struct("_brand", "_model", "year")), "demand", [F.asc("least")], k)
    kind = F.struct("e_brand", "e_model", "e_year")
    codes = top_k(of_entry.select(kind.alias("kind"), "code"), "kind", [F.asc("code")], k).drop("rank")
    found = top_k(first.select("demand", kind.alias("kind")).join(codes.hint("merge"), "kind"), "demand", [F.asc("code")], k)
    return q.select(query, F.struct("_brand", "_model", year).alias("demand")).join(found.hint("merge"), "demand").select(query, "code", "rank")


def diagnostics(candidates: DataFrame, query: str) -> DataFrame:
    """What a query's candidates (brand, model, year, description) are like: counts, brands, quality and how it is distributed."""
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    year = F.coalesce(F.col("year"), F.lit(0)) != 0
    points = sum(F.when(c, n).otherwise(0) for c, n in ((there("brand"), 30), (there("model"), 30), (year, 20), (F.length("description") > 10, 20)))
    s = candidates.withColumn("_s", points)
    return s.groupBy(query).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(there("brand") & there("model")).alias("valid"), F.count_if(year).alias("with_year"), F.count_distinct(F.when(there("brand"), F.col("brand"))).alias("brands"), F.round(F.avg("_s") / 100, 6).alias("quality"),
        F.count_if(F.col("_s") >= 80).alias("high"), F.count_if((F.col("_s") >= 50) & (F.col("_s") < 80)).alias("medium"), F.count_if(F.col("_s") < 50).alias("low"),
    )


def capped(candidates: DataFrame, query: str, k: int = 100) -> DataFrame:
    """The k candidates of each query to go on with: those with a year, with a longer description, with more tokens first, then by code."""
    tokens = F.size(T.words_of(F.col("description")))
    return top_k(candidates, query, [F.col("year").isNotNull().desc(), F.length("description").desc_nulls_last(), tokens.desc(), F.asc("code")], k)


def weighted_score(q: dict[str, Column], e: dict[str, Column], description: Column) -> Column:
    """Brand .3, model .3, year .2, fuel .1 and drivetrain .1, over the weights of what both sides tell; 0 where that is nothing."""
    up = lambda c: F.upper(c)
    told = lambda c: c.isNotNull() & (c.cast("string") != "")
    text = F.upper(F.coalesce(description, F.lit("")))
    parts = [
        (told(q["brand"]) & e["brand"].isNotNull(), up(q["brand"]) == up(e["brand"]), 3), (told(q["model"]) & e["model"].isNotNull(), up(e["model"]).contains(up(q["model"])), 3), (q["year"].isNotNull() & e["year"].isNotNull(), q["year"] == e["year"], 2),
        (told(q["fuel"]), text.contains(up(q["fuel"])), 1), (told(q["drivetrain"]), text.contains(up(q["drivetrain"])), 1),
    ]
    weight = sum(F.when(c, w).otherwise(0) for c, _, w in parts)
    return F.when(weight == 0, 0.0).otherwise(sum(F.when(c & hit, w).otherwise(0) for c, hit, w in parts) / weight)


def match_map(q: dict[str, Column], e: dict[str, Column], description: Column) -> Column:
    """A map of seven flags: brand, model and year are false, the attributes true where the record tells nothing."""
    first = lambda c, hit: F.coalesce(c.isNotNull() & hit, F.lit(False))
    allow = lambda n, variants: H.allows(q[n], description, variants)
    trim = F.when(q["trim"].isNull(), True).otherwise(F.upper(description).contains(F.upper(q["trim"])))
    flags = {"brand_match": first(q["brand"], F.upper(q["brand"]) == F.upper(e["brand"])), "model_match": first(q["model"], F.upper(e["model"]).contains(F.upper(q["model"]))), "year_match": first(q["year"], q["year"] == e["year"]), "fuel_match": allow("fuel", H.FUEL_VARIANTS), "drivetrain_match": allow("drivetrain", H.DRIVETRAIN_VARIANTS), "body_match": allow("body", H.BODY_VARIANTS), "trim_match": trim}
    return F.create_map(*(x for n, c in flags.items() for x in (F.lit(n), F.coalesce(c, F.lit(False)))))


def match_warnings(confidence: Column, core: Column, q_year: Column, year: Column) -> Column:
    far = F.abs(q_year - year) > 2
    return F.array_compact(F.array(
        F.when(confidence < 0.6, "Low confidence match - manual review recommended"), F.when(~core, "Incomplete vehicle attributes - brand, model, or year missing"),
        F.when(far, F.concat(F.lit("Year mismatch: input "), q_year.cast("string"), F.lit(" vs matched "), year.cast("string"))), F.when(year.isNull(), "Matched entry has incomplete year data"),
    ))


def chosen_option(reply: Column, n: Column) -> Column:
    """The place, from 0 on, of the option that a model's reply names: its first digit from 1 to n, else the number after `option`."""
    clean = F.lower(F.trim(reply))
    digits = F.filter(F.transform(F.regexp_extract_all(clean, F.lit("([0-9])"), F.lit(1)), lambda d: d.cast("int") - 1), lambda i: (i >= 0) & (i < n))
    named = F.regexp_extract(clean, r"option\s+([0-9]+)", 1).try_cast("int") - 1
    return F.coalesce(F.get(digits, 0), F.when((named >= 0) & (named < n), named))


def export_summary(rows: DataFrame, run: str, decision: str, corrected: str) -> DataFrame:
    """Rows of each run by what became of them: accepted, reviewed (corrected by hand, or a match that was to be looked at) and unresolved."""
    fixed = F.col(corrected).isNotNull()
    accepted = (F.col(decision) == "auto_accept") & ~fixed
    reviewed = fixed | (F.col(decision) == "needs_review")
    return rows.groupBy(run).agg(F.count(F.lit(1)).alias("rows_total"), F.count_if(accepted).alias("rows_auto_accepted"), F.count_if(reviewed).alias("rows_reviewed"), F.count_if(~F.coalesce(accepted | reviewed, F.lit(False))).alias("rows_unresolved"))


def chunks(requests: DataFrame, order: list[Column], size: int = 50) -> DataFrame:
    """Requests with their place and chunk, in order, so that results can be put back in it after any shuffle."""
    out = numbered(requests, order, "place")
    return out.withColumn("chunk", F.floor(F.col("place") / size))


def assembled_case(mails: DataFrame, attachments: DataFrame, mail: str, fields: list[str], place: str) -> DataFrame:
    """A case of each mail: each field from the mail, else from the first of its attachments (by `place`) that tells it; a broker without
    an address or a name gets the sender's (from_email, from_name)."""
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    own = attachments.groupBy(mail).agg(*(F.min_by(told(c), F.when(told(c).isNotNull(), F.col(place))).alias(f"_{c}") for c in fields))
    sender = {"broker_email": "from_email", "broker_name": "from_name"}
    value = lambda c: F.coalesce(told(c), *([told(sender[c])] if c in sender else []), F.col(f"_{c}"))
    return mails.join(own, mail, "left").select(mail, *(value(c).alias(c) for c in fields))


def catch_up(messages: DataFrame, known: DataFrame, key: str, status: str) -> tuple[DataFrame, DataFrame]:
    """(messages to work on, counts by folder): those that are not known as PROCESSED; without a key a message is an error."""
    last = known.groupBy(key).agg(F.max(F.col(status) == "PROCESSED").alias("_done"))
    m = messages.join(last, key, "left").withColumn("_state", F.when(F.col(key).isNull(), "errors").when(F.col("_done"), "skipped").otherwise("processed"))
    of = lambda s: F.count_if(F.col("_state") == s).alias(s)
    return m.where("_state = 'processed'").drop("_state", "_done"), m.groupBy("folder").agg(F.count(F.lit(1)).alias("total"), of("processed"), of("skipped"), of("errors"))


def codify_triggers(runs: DataFrame) -> DataFrame:
    """A message for each case of runs (case_id, run_id, component, status, ready, at) whose transform is a success and ready, with the
    latest such run; none where the case was codified after it."""
    ready = (F.col("component") == "TRANSFORM") & (F.col("status") == "SUCCESS") & F.col("ready")
    w = Window.partitionBy("case_id")
    r = runs.withColumns({"_ready": F.max(F.when(ready, F.struct("at", "run_id"))).over(w), "_codified": F.max(F.when(F.col("component") == "CODIFY", F.col("at"))).over(w)})
    due = r.where(ready & (F.struct("at", "run_id") == F.col("_ready")) & (F.col("_codified").isNull() | (F.col("_codified") < F.col("at")))).select("case_id", "run_id").distinct()
    payload = F.to_json(F.struct("run_id", "case_id", F.lit("api").alias("triggered_by")))
    return due.select(F.sha2(F.concat_ws("/", "case_id", "run_id"), 256).alias("msg_id"), "case_id", "run_id", F.lit("CODIFY").alias("component"), payload.alias("payload"))
