"""Coverages, limits and deductibles as they stand in policy rows and mails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Standard coverages and what senders call them.
COVERAGES = {
    "TODO RIESGO": ("todo riesgo", "comprehensive", "cobertura completa", "full coverage", "amplia"),
    "RESPONSABILIDAD CIVIL": ("responsabilidad civil", "liability", "rc", "terceros", "civil liability"),
    "COLISION": ("colisión", "collision", "choque", "accidente"),
    "ROBO": ("robo", "theft", "hurto", "robo total"),
    "INCENDIO": ("incendio", "fire", "fuego"),
    "DESASTRES NATURALES": ("desastres naturales", "natural disasters", "catastrofes naturales", "fenomenos naturales"),
}
#: Codes of coverages.
CODES = {"BI": "RESPONSABILIDAD CIVIL", "PD": "DAÑOS A PROPIEDAD", "COMP": "TODO RIESGO", "COLL": "COLISION", "UM": "MOTORISTA SIN SEGURO", "UIM": "MOTORISTA SUBSEGURADO"}
#: How limits are written, and what the number is multiplied by.
LIMITS = ((r"^\$([0-9,]+)$", 1), (r"^([0-9,]+)\s*USD$", 1), (r"^([0-9,]+)K$", 1000), (r"^([0-9,]+)M$", 1000000))
#: Standard deductibles, as amounts and as per cents of the vehicle's value.
DEDUCTIBLES, SHARES = ("500", "1000", "2500", "5000", "10000"), ("1%", "2%", "5%", "10%")
#: What stands for an unknown coverage and an unreadable limit.
UNKNOWN, UNREAD = "UNKNOWN", "TBD"
#: Fixed value: a coverage and its limit in a mail.
PAIR = r"(?:COBERTURA|COVERAGE):\s*([A-Z\s]+)(?:\s+LÍMITE|LIMIT):\s*([0-9,$\s]+)"


def names() -> dict[str, str]:
    """Every alias and code, in lower case, with its standard coverage."""
    return {a: name for name, aliases in COVERAGES.items() for a in (name.lower(), *aliases)} | {c.lower(): name for c, name in CODES.items()}


def coverage(c: Column) -> Column:
    """The standard coverage; UNKNOWN for others and for null."""
    known = F.create_map(*(F.lit(x) for pair in names().items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(T.collapse(c))), F.lit(UNKNOWN))


def limit_amount(c: Column) -> Column:
    """The limit as a whole number; null where it has no known form."""
    v = F.upper(F.trim(c))
    return F.coalesce(*(F.when(v.rlike(p), F.replace(F.regexp_extract(v, p, 1), F.lit(","), F.lit("")).try_cast("long") * times) for p, times in LIMITS))


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def limit_text(c: Column) -> Column:
    return F.coalesce(money_text(limit_amount(c)), F.lit(UNREAD))


def deductible_text(c: Column) -> Column:
    """A standard deductible in words; null for others."""
    v = F.trim(c)
    return F.when(v.isin(*SHARES), F.concat(v, F.lit(" of vehicle value"))).when(v.isin(*DEDUCTIBLES), money_text(v.try_cast("long")))


def needs_review(kind: Column, limit: Column, deductible: Column) -> Column:
    """Unknown coverage, unreadable limit, or a deductible above the limit."""
    amount = limit_amount(limit)
    return (coverage(kind) == UNKNOWN) | amount.isNull() | F.coalesce(F.trim(deductible).try_cast("long") > amount, F.lit(False))


def coverage_pairs(text: Column) -> Column:
    """The coverages of a mail with their limits, as an array of structs; the pattern ignores case."""
    part = lambda i: F.regexp_extract_all(text, F.lit("(?iu)" + PAIR), F.lit(i))
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.zip_with(part(1), part(2), lambda a, b: F.struct(bare(a).alias("coverage"), bare(b).alias("limit")))
