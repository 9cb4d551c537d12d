"""An interpreter for the rules of a profile: transformations and validations of fields, and what happens to a row that breaks one.

All rules become one projection: each field's new value and one array of the row's errors. A row's outcome follows from the policies: warn
keeps it with its errors, skip sets it aside, fail marks it and lets `split` raise. Corrupt rows, which no parser could read,
are set aside with their text. Kept and set-aside rows come from one pass, and together they are the input.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.files import work_dir

CORRUPT, ERRORS, OUTCOME = "_corrupt", "errors", "outcome"
ERROR = "array<struct<field:string,rule:string,value:string>>"


def _case(c: Column, case: str = "upper") -> Column:
    return {"title": F.initcap, "upper": F.upper, "lower": F.lower}[case](c)


def _mapped(c: Column, mappings: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in mappings.items() for x in kv)), c), c) if mappings else c


def _collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


#: Transformations: a new value of a field.
CHANGES = {
    "normalize_case": lambda c, p: _case(c, **p), "map_values": lambda c, p: _mapped(c, **p), "remove_extra_spaces": lambda c, p: _collapsed(c),
    "standardize_model_names": lambda c, p: F.upper(_collapsed(c)), "convert_to_int": lambda c, p: F.floor(_number(c)).cast("int").cast("string"),
}
#: Checks: true where a value breaks the rule; the fields are those of `field` or `fields`.
CHECKS = {
    "validate_range": lambda c, p: c.isNotNull() & ~F.coalesce(_number(c).between(p["min"], p["max"]), F.lit(False)), "convert_to_int": lambda c, p: c.isNotNull() & (F.trim(c.cast("string")) != "") & _number(c).isNull(),
    "valid_year_range": lambda c, p: c.isNotNull() & ~F.coalesce(_number(c).between(p["min"], p["max"]), F.lit(False)), "no_empty_strings": lambda c, p: c.isNotNull() & (F.trim(c) == ""),
    "known_coverage_types": lambda c, p: c.isNotNull() & ~c.isin(*p["allowed_values"]),
}
POLICIES = ("warn", "skip", "fail")


def _worst(policies: list[tuple[Column, str]]) -> Column:
    """The outcome of the strictest policy whose condition holds."""
    out = F.lit("kept")
    for policy, name in (("skip", "skipped"), ("fail", "failed")):
        for broken, p in policies:
            if p == policy:
                out = F.when(broken, name).otherwise(out)
    return out


def apply_rules(df: DataFrame, profile: dict[str, Any]) -> DataFrame:
    """df with its fields transformed, an array of errors (field, rule, value) and the outcome of each row: kept, skipped, failed or, where
    the corrupt-record column holds something, corrupt. A field that isn't there is null. Raises ValueError for unknown rules."""
    handling = {"on_validation_error": "warn", "on_transformation_error": "warn", "required_field_missing": "fail"} | profile.get("error_handling", {})
    if bad := [p for p in handling.values() if p not in POLICIES]:
        raise ValueError(f"unknown policy {bad[0]}")
    validations = profile.get("validations", {})
    required = validations.get("required_fields", [])
    steps = [(field, rule["rule"], rule.get("params", {})) for field, rules in profile.get("transformations", {}).items() for rule in rules]
    checks = [(field, rule["rule"], rule.get("params", {})) for rule in validations.get("data_quality", []) for field in rule.get("fields", [rule.get("field")])]
    if unknown := [r for _, r, _ in steps if r not in CHANGES and r not in CHECKS] + [r for _, r, _ in checks if r not in CHECKS]:
        raise ValueError(f"unknown rule {unknown[0]}")
    fields = list(dict.fromkeys([f for f, _, _ in steps] + [f for f, _, _ in checks] + required))
    value = {f: F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string") for f in fields}
    found: list[tuple[Column, str, Column]] = []

    def note(field: str, rule: str, broken: Column, policy: str) -> None:
        found.append((F.when(broken, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), value[field].alias("value"))), policy, broken))

    for field, rule, p in steps:
        if rule in CHECKS:
            note(field, rule, CHECKS[rule](value[field], p), handling["on_transformation_error"])
        if rule in CHANGES:
            value[field] = CHANGES[rule](value[field], p)
    for field in required:
        note(field, "required", F.coalesce(F.trim(value[field]), F.lit("")) == "", handling["required_field_missing"])
    for field, rule, p in checks:
        note(field, rule, CHECKS[rule](value[field], p), handling["on_validation_error"])
    errors = F.filter(F.array(*(e for e, _, _ in found)), lambda x: x.isNotNull()) if found else F.array().cast(ERROR)
    outcome = _worst([(F.coalesce(broken, F.lit(False)), policy) for _, policy, broken in found])
    if CORRUPT in df.columns:
        whole = F.col(CORRUPT).isNull()
        errors, outcome = F.when(whole, errors).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("corrupt").alias("rule"), F.col(CORRUPT).alias("value")))), F.when(whole, outcome).otherwise("corrupt")
    return df.select(*(c for c in df.columns if c not in value), *(v.alias(f) for f, v in value.items()), errors.alias(ERRORS), outcome.alias(OUTCOME))


def read_rows(spark: SparkSession, path: str, schema: StructType, format: str = "csv", **options: str) -> DataFrame:
    """Rows of text files by a schema; what doesn't parse is null, and such a row has its text in the corrupt-record column."""
    with_text = StructType([*schema.fields]).add(CORRUPT, "string")
    return spark.read.schema(with_text).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **options).format(format).load(path)


def split(judged: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, set aside) of apply_rules' rows, from one pass that writes them by outcome. Raises ValueError where a row failed."""
    spark = judged.sparkSession
    path = path or work_dir(spark)
    judged.write.partitionBy(OUTCOME).parquet(path)
    rows = spark.read.schema(judged.schema).parquet(path).select(*judged.columns)
    failed = rows.where(f"{OUTCOME} = 'failed'")
    if first := failed.head(1):
        raise ValueError(f"{failed.count()} rows failed, one with {first[0][ERRORS]}")
    return rows.where(f"{OUTCOME} = 'kept'"), rows.where(f"{OUTCOME} <> 'kept'")
