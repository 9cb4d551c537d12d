"""Checks of whole rows: extracted rows, template columns, the canonical vehicle, settings of a match; rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators.profile import field_errors

#: The columns of the standard template, the canonical vehicle and its lists.
TEMPLATE = {
    "MARCA": {"type": "text", "required": True, "max_length": 50}, "MODELO": {"type": "text", "required": True, "max_length": 100}, "AÑO": {"type": "integer", "required": True, "min_value": 1980, "max_value": 2030},
    "VIN": {"type": "text", "max_length": 17, "pattern": "^[A-HJ-NPR-Z0-9]{17}$"}, "COBERTURA": {"type": "text", "required": True, "max_length": 100}, "LIMITE": {"type": "currency"}, "CVEGS": {"type": "text", "required": True, "max_length": 20},
    "SCORE": {"type": "decimal", "min_value": 0.0, "max_value": 1.0, "decimals": 3}, "REVIEWED": {"type": "boolean"},
}
CANONICAL = {
    "vin": {"required": True, "min_length": 17, "max_length": 17}, "description": {"required": True, "max_length": 500}, "brand": {"required": True, "max_length": 100}, "model_year": {"required": True, "min_value": 1900, "max_value": 2100},
    "license_plate": {"max_length": 20}, "subbrand": {"max_length": 100}, "unit_type": {"max_length": 50}, "insured_value": {"min_value": 0}, "currency": {"min_length": 3, "max_length": 3}, "company_name": {"max_length": 200},
}


def _there(df: DataFrame, c: str) -> Column:
    return F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")


def extracted_errors(df: DataFrame, fields: list[str], this_year: int) -> Column:
    """Messages of an extracted row: one if it is empty, else those of vin, model_year and license_plate where they hold something."""
    blank = F.lit(True)
    for c in fields:
        blank &= F.coalesce(F.trim(_there(df, c).cast("string")), F.lit("")) == ""
    none = F.array().cast("array<string>")
    own = lambda c, errors: F.when(F.coalesce(_there(df, c).cast("string"), F.lit("")) == "", none).otherwise(errors(_there(df, c).cast("string")))
    return F.when(blank, F.array(F.lit("Row is completely empty"))).otherwise(F.concat(own("vin", T.vin_errors), own("model_year", lambda c: V.year_errors(c, this_year)), own("license_plate", V.plate_errors)))


def template_errors(df: DataFrame, template: dict[str, dict] | None = None) -> Column:
    """Messages of a row under a template's columns: those of field_errors, whole numbers, decimals of at most so many digits, booleans
    and amounts."""
    out = []
    for c, rules in (template or TEMPLATE).items():
        value = _there(df, c).cast("string")
        out.append(field_errors(value, c, {k: v for k, v in rules.items() if k not in ("type", "decimals")}))
        s = F.nullif(F.trim(value), F.lit(""))
        kind = {"integer": ~s.rlike(r"^-?[0-9]+$"), "decimal": s.try_cast("double").isNull(), "currency": s.rlike("[^0-9.,$ -]"), "boolean": ~F.lower(s).isin("true", "false")}.get(rules.get("type"))
        wrong = [] if kind is None else [F.when(s.isNotNull() & kind, f"{c} must be of type {rules['type']}")]
        if "decimals" in rules:
            wrong.append(F.when(s.rlike(rf"\.[0-9]{{{rules['decimals'] + 1},}}"), f"{c} must have at most {rules['decimals']} decimals"))
        if wrong:
            out.append(V.messages(*wrong))
    return F.concat(*out)


def canonical(df: DataFrame) -> DataFrame:
    """df with the canonical vehicle's fields in their form (vin, currency upper-cased, plate without spaces) and an `errors` array; fields
    that aren't there are null, and may be so if they aren't required."""
    fields = {c: _there(df, c).cast("string") for c in (*CANONICAL, "policy_start", "policy_end")}
    start, end = (fields[c].try_cast("date") for c in ("policy_start", "policy_end"))
    errors = F.concat(
        *(field_errors(fields[c], c, rules) for c, rules in CANONICAL.items()), V.messages(F.when(~F.upper(fields["vin"]).rlike("^[A-HJ-NPR-Z0-9]{17}$"), "VIN must be 17 alphanumeric characters (excluding I, O, Q)")),
        V.messages(*(F.when(fields[c].isNotNull() & d.isNull(), f"{c} must be a date") for c, d in (("policy_start", start), ("policy_end", end)))), V.messages(F.when(end <= start, "Policy end date must be after start date")),
    )
    form = fields | {"vin": F.upper(fields["vin"]), "currency": F.upper(fields["currency"]), "license_plate": F.regexp_replace(F.upper(fields["license_plate"]), r"\s+", "")}
    return df.select(*(c for c in df.columns if c not in form), *(v.alias(c) for c, v in form.items()), errors.alias("errors"))


def check_criteria(weights: dict[str, float], attribute_weights: dict[str, float], least: float, fuzzy: float, exact: float, candidates: int) -> None:
    """Raises ValueError for settings of a match that make no sense."""
    for name, own in (("Core matching", weights), ("Attribute", attribute_weights)):
        if not 0.95 <= sum(own.values()) <= 1.05:
            raise ValueError(f"{name} weights must sum to about 1: {sum(own.values())}")
    if not all(0 <= x <= 1 for x in (least, fuzzy, exact)):
        raise ValueError("Thresholds must be between 0 and 1")
    if not least <= fuzzy <= exact:
        raise ValueError("Thresholds must be in order: least, fuzzy, exact")
    if candidates <= 0:
        raise ValueError("Candidates must be positive")


def broken_rows(df: DataFrame, index: str, rules: list[str]) -> DataFrame:
    """(rule, row_index) of every row that breaks a rule, where `rules` are columns of flags: one row each, so that no list of indices is
    gathered; sorted lists are an order of it."""
    own = F.filter(F.array(*(F.when(F.col(r), F.lit(r)) for r in rules)), lambda x: x.isNotNull())
    return df.select(F.explode(own).alias("rule"), F.col(index).alias("row_index"))
