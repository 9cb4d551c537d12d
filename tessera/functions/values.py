"""Values of rows: cleaning, typed conversion, validation messages, mail fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Fixed values that results depend on.
EMPTY_WORDS = ("nan", "null", "none", "n/a", "na")
JUNK_PLATES = ("n/a", "na", "none", "null", "test")
FLEET, CLAIM, RENEWAL = ("FLEET", "FLOTA", "COTIZACIÓN", "QUOTE", "VEHÍCULOS"), ("SINIESTRO", "CLAIM", "ACCIDENTE", "DAMAGE"), ("RENOVACIÓN", "RENEWAL", "PÓLIZA", "POLICY")
VEHICLE_BRANDS = ("TOYOTA", "HONDA", "NISSAN", "MITSUBISHI", "FORD", "CHEVROLET", "VOLKSWAGEN", "GENERAL MOTORS", "GM", "HYUNDAI", "KIA", "TRACTO", "REMOLQUE", "CAMION", "AUTO", "PICKUP")
VEHICLE_TRAITS = ("DIESEL", "GASOLINA", "4X4", "4X2", "AUTOMATICO", "MANUAL")
MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# Patterns of mails, in any case of letters; a name goes on over line ends until something else than letters, blanks and dots.
PATTERNS = {
    "client_name": (r"(?:CLIENTE|CLIENT|ASEGURADO):\s*([A-Z\s\.]+)", r"(?:NOMBRE|NAME):\s*([A-Z\s\.]+)", r"(?:RAZÓN SOCIAL|COMPANY):\s*([A-Z\s\.]+)"),
    "client_rfc": (r"(?:RFC):\s*([A-Z0-9]{10,13})", r"\b([A-Z]{3,4}\d{6}[A-Z0-9]{3})\b"),
    "broker_name": (r"(?:BROKER|AGENTE|INTERMEDIARIO):\s*([A-Z\s\.]+)", r"(?:CORREDOR):\s*([A-Z\s\.]+)"),
    "broker_email": (rf"(?:EMAIL|CORREO):\s*({MAIL})", rf"\b({MAIL})\b"),
}
LOSS = (r"(?:HISTORIAL DE SINIESTROS|LOSS HISTORY):\s*([A-Z\s]+)", r"(?:SINIESTROS|CLAIMS):\s*(SÍ|NO|YES|NO)")


def text_value(c: Column) -> Column:
    """Null for the words that mean none, else the text with single spaces."""
    bare = F.trim(c)
    return F.when((bare == "") | F.lower(bare).isin(*EMPTY_WORDS), None).otherwise(T.collapse(bare))


def plate(c: Column) -> Column:
    return F.nullif(T.collapse(F.upper(c)), F.lit(""))


def vin(c: Column) -> Column:
    return F.nullif(F.upper(F.replace(c, F.lit(" "), F.lit(""))), F.lit(""))


#: Target fields of a transformation with a type of their own.
TYPED = {"vehicle_year": T.bounded_year, "model_year": T.bounded_year, "insured_value": T.parse_currency, "premium": T.parse_currency, "deductible": T.parse_currency, "vin": vin, "license_plate": plate}


def transformed(c: Column, field: str) -> Column:
    return TYPED.get(field, text_value)(F.trim(c.cast("string")))


def converted(c: Column, kind: str) -> Column:
    """A text as an export type; int is null where it is no number, percent is a hundredth."""
    c = F.nullif(c.cast("string"), F.lit(""))
    if kind == "int":
        return F.when(F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit("-"), F.lit("")).rlike("^[0-9]+$"), c.try_cast("double").cast("int"))
    if kind == "percent":
        return F.replace(c, F.lit("%"), F.lit("")).try_cast("double") / 100.0
    return c.try_cast("double") if kind == "float" else c.try_cast("date") if kind == "date" else c


def messages(*each: Column) -> Column:
    return F.array_compact(F.array(*each))


def year_errors(c: Column, this_year: int) -> Column:
    y = c.try_cast("double").cast("int")
    wrong = F.when(y.isNull(), F.concat(F.lit("Invalid year format: "), c)).when(y < 1900, F.concat(F.lit("Year "), y.cast("string"), F.lit(" is too old (minimum: 1900)"))).when(y > this_year + 2, F.concat(F.lit("Year "), y.cast("string"), F.lit(" is in the future")))
    return messages(F.when(c.isNotNull() & (c != ""), wrong))


def plate_errors(c: Column) -> Column:
    bare = F.trim(c)
    n = F.length(bare)
    long = F.when((n < 3) | (n > 10), F.concat(F.lit("License plate length unusual: "), n.cast("string"), F.lit(" characters")))
    return messages(F.when(c != "", long), F.when(F.lower(bare).isin(*JUNK_PLATES), F.concat(F.lit("Invalid license plate: "), bare)))


def business_errors(insured: Column, premium: Column, year: Column, brand: Column) -> Column:
    ratio = F.when((insured != 0) & (premium != 0), premium / insured)
    return messages(
        F.when((insured != 0) & (insured < 1000), "Insured value seems too low (< $1,000)").when(insured > 10_000_000, "Insured value seems too high (> $10,000,000)"),
        F.when(ratio > 0.5, "Premium seems too high relative to insured value").when(ratio < 0.001, "Premium seems too low relative to insured value"),
        F.when((F.upper(brand) == "TESLA") & (year < 2008), F.concat(F.lit("Tesla did not manufacture vehicles in "), year.cast("string"))),
    )


def mail_fields(text: Column) -> dict[str, Column]:
    """Client and broker of a mail text, cleaned: names in title case, RFC of 10 to 13 letters and digits, e-mail as found."""
    found = {f: F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, f"(?i){p}", 1)), F.lit("")) for p in own)) for f, own in PATTERNS.items()}
    rfc = F.regexp_replace(F.upper(found["client_rfc"]), "[^A-Z0-9]", "")
    name = lambda c: F.initcap(F.lower(T.collapse(c)))
    return {"client_name": name(found["client_name"]), "client_rfc": F.when(F.length(rfc).between(10, 13), rfc), "broker_name": name(found["broker_name"]), "broker_email": found["broker_email"]}


def loss_history(text: Column) -> Column:
    found = [F.nullif(F.trim(F.regexp_extract(text, f"(?i){p}", 1)), F.lit("")) for p in LOSS]
    return F.coalesce(*found, F.nullif(F.regexp_extract(text, "(?i)(SIN SINIESTROS|NO CLAIMS)", 1), F.lit("")), F.nullif(F.regexp_extract(text, "(?i)(CON SINIESTROS|WITH CLAIMS)", 1), F.lit("")))


def holds(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.upper(c).contains(w)
    return out


def mail_type(subject: Column, text: Column) -> Column:
    both = F.concat_ws("\n", subject, text)
    return F.when(holds(both, FLEET), "fleet_quote").when(holds(both, CLAIM), "claim_report").when(holds(both, RENEWAL), "policy_renewal").otherwise("general_inquiry")


def vehicle_line(c: Column) -> Column:
    """Whether a line looks like a vehicle: a brand, and a year or a trait."""
    return holds(c, VEHICLE_BRANDS) & (c.rlike(r"\b(19|20)[0-9]{2}\b") | holds(c, VEHICLE_TRAITS))


def clean_vehicle(c: Column) -> Column:
    """A mined description without label, number or bullet, in upper case; empty where at most five characters stay."""
    for p in (r"(?i)^(VEHÍCULO|VEHICLE|UNIDAD):\s*", r"^[0-9]+[.)]\s*", r"^[-*]\s*"):
        c = F.regexp_replace(T.collapse(c), p, "")
    out = F.trim(F.upper(c))
    return F.when(F.length(out) > 5, out).otherwise("")


#: Words in the header of a table's column that holds vehicles.
VEHICLE_HEADERS = ("VEHÍCULO", "VEHICLE", "DESCRIPCIÓN", "DESCRIPTION", "UNIDAD")


def table_vehicles(rows: Column) -> Column:
    """Cleaned vehicles of a table, an array of rows of cells whose first row is the header: of the columns whose header names
    vehicles, of all columns of the header where none does. Cells that a row lacks are left out; no table gives no vehicles."""
    none = F.array().cast("array<string>")
    head = F.coalesce(F.get(rows, 0), none)
    places = F.when(F.size(head) > 0, F.sequence(F.lit(0), F.size(head) - 1)).otherwise(F.array().cast("array<int>"))
    named = F.filter(places, lambda i: F.coalesce(holds(F.get(head, i), VEHICLE_HEADERS), F.lit(False)))
    use = F.when(F.size(named) > 0, named).otherwise(places)
    cells = F.flatten(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: F.transform(use, lambda i: F.get(r, i))))
    return F.coalesce(F.filter(F.transform(F.filter(cells, lambda c: c.isNotNull() & vehicle_line(c)), clean_vehicle), lambda v: v != ""), none)
