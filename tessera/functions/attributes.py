"""Attributes of a vehicle from several sources: codes, merging, completeness, confidence and checks, as Columns over structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
FUEL_CODES = {"DIESEL": "DIESEL", "TD": "DIESEL", "TDI": "DIESEL", "GASOLINA": "GASOLINE", "GASOLINE": "GASOLINE", "GAS": "GASOLINE", "NAFTA": "GASOLINE", "ELECTRIC": "ELECTRIC", "ELECTRICO": "ELECTRIC", "HYBRID": "HYBRID", "HIBRIDO": "HYBRID"}
DRIVETRAIN_CODES = {"4X4": "4X4", "4WD": "4X4", "AWD": "AWD", "4X2": "4X2", "2WD": "4X2", "FWD": "FWD", "RWD": "RWD"}
BODY_CODES = {
    "DC": "DOUBLE_CAB", "DOBLE CABINA": "DOUBLE_CAB", "DOUBLE CAB": "DOUBLE_CAB", "SC": "SINGLE_CAB", "CABINA SIMPLE": "SINGLE_CAB", "SINGLE CAB": "SINGLE_CAB", "SEDAN": "SEDAN", "4P": "SEDAN", "4 PUERTAS": "SEDAN",
    "SUV": "SUV", "SPORT UTILITY": "SUV", "HATCHBACK": "HATCHBACK", "5P": "HATCHBACK", "PICKUP": "PICKUP", "PICK UP": "PICKUP", "CAMIONETA": "PICKUP",
}
FIELDS = {"brand": "string", "model": "string", "year": "int", "vin": "string", "coverage": "string", "fuel": "string", "drivetrain": "string", "body": "string", "trim": "string", "engine": "string", "transmission": "string", "doors": "int"}
COUNTED = ("brand", "model", "year", "vin", "fuel", "drivetrain", "body", "trim", "engine", "transmission")
ENHANCED = ("fuel", "drivetrain", "body", "trim", "engine", "transmission")


def code(c: Column, codes: dict[str, str]) -> Column:
    """The standard code of a value in any case, else the value itself; a blank one is null."""
    known = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.nullif(F.coalesce(F.element_at(known, F.upper(c)), c), F.lit(""))


def told(c: Column, kind: str) -> Column:
    """A value that says something: neither null nor empty nor 0."""
    return F.nullif(c, F.lit(0) if kind == "int" else F.lit(""))


def merged(*sources: Column) -> Column:
    """A struct of FIELDS, each from the first source that tells it: give Excel, then the model, then rules."""
    return F.struct(*(F.coalesce(*(told(s[f].cast(kind), kind) for s in sources)).alias(f) for f, kind in FIELDS.items()))


def completeness(a: Column) -> Column:
    return sum(a[f].isNotNull().cast("int") for f in COUNTED) / float(len(COUNTED))


def has_excel(a: Column, excel: Column) -> Column:
    return F.coalesce(*(told(a[f], FIELDS[f]).cast("string") for f in ("brand", "model", "year", "vin", "coverage"))).isNotNull() & (F.coalesce(excel, F.lit(0.0)) > 0)


def overall_confidence(a: Column, excel: Column, model: Column) -> Column:
    """0.7 of the sheet's confidence and 0.3 of the model's where the sheet gave anything, else the model's."""
    model = F.coalesce(model, F.lit(0.0))
    return F.when(has_excel(a, excel), excel * 0.7 + model * 0.3).otherwise(model)


def checks(a: Column, excel: Column) -> Column:
    """A map of checks: core, sheet and enhanced attributes there, the year in bounds, codes that could be made."""
    any_of = lambda names: F.coalesce(*(told(a[f], FIELDS[f]).cast("string") for f in names)).isNotNull()
    core = F.lit(True)
    for f in ("brand", "model", "year"):
        core &= told(a[f], FIELDS[f]).isNotNull()
    coded = lambda f, codes: F.when(told(a[f], "string").isNull(), True).otherwise(code(a[f], codes).isNotNull())
    year = F.when(told(a["year"], "int").isNull(), True).otherwise(a["year"].between(1900, 2030))
    found = {"has_core_attributes": core, "has_excel_data": has_excel(a, excel), "has_enhanced_attributes": any_of(ENHANCED), "year_valid": year, "fuel_type_normalized": coded("fuel", FUEL_CODES), "drivetrain_normalized": coded("drivetrain", DRIVETRAIN_CODES), "body_style_normalized": coded("body", BODY_CODES)}
    return F.create_map(*(x for name, c in found.items() for x in (F.lit(name), c)))


def invariant_errors(a: Column, excel: Column, model: Column) -> Column:
    """Messages of what no vehicle may have: a year out of 1900 to 2030, doors out of 2 to 6, confidences out of 0 to 1."""
    out = F.array(
        F.when(~a["year"].between(1900, 2030), F.concat(F.lit("Invalid year: "), a["year"].cast("string"))), F.when(~a["doors"].between(2, 6), F.concat(F.lit("Invalid doors: "), a["doors"].cast("string"))),
        F.when(~excel.between(0, 1), F.concat(F.lit("Excel confidence must be between 0.0 and 1.0: "), excel.cast("string"))), F.when(~model.between(0, 1), F.concat(F.lit("LLM confidence must be between 0.0 and 1.0: "), model.cast("string"))),
    )
    return F.array_compact(out)
