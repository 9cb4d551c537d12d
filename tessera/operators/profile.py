"""Profiles compiled to Column expressions: headers, mappings, normalisation, computed columns, rules and reports.

A profile is data; apply_profile turns it into one projection, so a table of any size takes one pass and no shuffle. The
report is one aggregation of flags.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V


@dataclass(frozen=True)
class Profile:
    required: tuple[str, ...] = ()
    columns: dict[str, str] = field(default_factory=dict)  # header -> canonical name
    normalize: dict[str, tuple[str, ...]] = field(default_factory=dict)  # column -> strip, lower, deburr
    compute: dict[str, str] = field(default_factory=dict)  # column -> "{brand} {model}"
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)


def headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower() for c in df.columns))


def normalized(c: Column, ops: tuple[str, ...]) -> Column:
    """strip, lower, deburr in this order, whatever order they are listed in; a null stays null."""
    c = c.cast("string")
    for name, f in (("strip", F.trim), ("lower", F.lower), ("deburr", T.deburr)):
        c = f(c) if name in ops else c
    return c


def template(expression: str, known: list[str]) -> Column:
    """Text with {name} replaced; null is empty, an unknown name stays as ${name}."""
    parts = re.split(r"\{(\w+)\}", expression)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) if p in known else F.lit(f"${{{p}}}") for i, p in enumerate(parts)))


def apply_profile(df: DataFrame, p: Profile) -> tuple[DataFrame, list[str]]:
    """(table with flags, missing headers): renamed, normalised, computed and checked, in this order. With a header missing
    nothing else happens."""
    df = headers(df)
    missing = [h for h in p.required if h.strip().lower() not in df.columns]
    if missing:
        return df, missing
    df = df.withColumnsRenamed({k: v for k, v in p.columns.items() if k in df.columns})
    df = df.withColumns({c: normalized(F.col(c), ops) for c, ops in p.normalize.items() if c in df.columns})
    for name, expression in p.compute.items():
        df = df.withColumn(name, template(expression, df.columns))
    flags = {}
    for c, (low, high) in p.ranges.items():
        n = F.col(c).cast("string").try_cast("double")
        flags[f"{c}_range"] = ~F.coalesce(F.col(c).cast("string").rlike("^[0-9]{4}$") & n.between(low, high), F.lit(False))
    for c, allowed in p.enums.items():
        flags[f"{c}_enum"] = ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    return df.withColumns({k: v for k, v in flags.items()}), []


def report(df: DataFrame, rules: list[str]) -> DataFrame:
    """rule, n: how many rows break each rule."""
    counted = df.agg(*(F.count_if(F.col(r)).alias(r) for r in rules))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules))).alias("x")).select("x.rule", "x.n")


def field_errors(c: Column, name: str, rules: dict) -> Column:
    """Messages of one field: required, min_length, max_length, min_value, max_value, pattern (from the start), allowed_values."""
    s = F.trim(c.cast("string"))
    n, empty = c.cast("string").try_cast("double"), c.isNull() | (F.trim(c.cast("string")) == "")
    wrong = []
    if "min_length" in rules:
        wrong.append(F.when(F.length(s) < rules["min_length"], f"{name} must be at least {rules['min_length']} characters"))
    if "max_length" in rules:
        wrong.append(F.when(F.length(s) > rules["max_length"], f"{name} must be at most {rules['max_length']} characters"))
    if "min_value" in rules or "max_value" in rules:
        wrong.append(F.when(n.isNull(), f"{name} must be a valid number"))
    if "min_value" in rules:
        wrong.append(F.when(n < rules["min_value"], f"{name} must be at least {rules['min_value']}"))
    if "max_value" in rules:
        wrong.append(F.when(n > rules["max_value"], f"{name} must be at most {rules['max_value']}"))
    if "pattern" in rules:
        wrong.append(F.when(~s.rlike(f"^(?:{rules['pattern']})"), f"{name} does not match required pattern"))
    if "allowed_values" in rules:
        wrong.append(F.when(~s.isin(*rules["allowed_values"]), f"{name} must be one of: {', '.join(rules['allowed_values'])}"))
    needed = F.array(F.lit(f"{name} is required")) if rules.get("required") else F.array().cast("array<string>")
    return F.when(empty, needed).otherwise(V.messages(*wrong) if wrong else F.array().cast("array<string>"))


def row_errors(rules: dict[str, dict]) -> Column:
    return F.concat(*(field_errors(F.col(c), c, r) for c, r in rules.items()))


def extract(df: DataFrame, synonyms: dict[str, tuple[str, ...]]) -> DataFrame:
    """Canonical columns: for each row the first header of a field's list with a value that isn't blank, then cleaned."""
    df = headers(df)

    def first(names: tuple[str, ...]) -> Column:
        own = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in df.columns]
        return T.clean_value(F.coalesce(*own)) if own else F.lit(None).cast("string")

    return df.select(*(first(names).alias(c) for c, names in synonyms.items()))


def field_mapped(df: DataFrame, mapping: dict[str, str], rules: dict[str, dict], concat: dict[str, tuple[tuple[str, ...], str]]) -> DataFrame:
    """Target fields from source columns by their types, messages of the rules, and fields joined from those that hold something."""
    out = df.select(*(c for c in df.columns if c not in mapping), *(V.transformed(F.col(s), t).alias(t) for t, s in mapping.items() if s in df.columns))
    joined = {t: F.nullif(F.concat_ws(sep, *(F.nullif(F.col(c).cast("string"), F.lit("")) for c in fields)), F.lit("")) for t, (fields, sep) in concat.items()}
    return out.withColumns({"validation_errors": row_errors(rules)} | joined)


def exported(df: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    """A template's columns (name, path with dots, type) from a table with nested columns; a path that isn't there is null."""
    from pyspark.sql.types import StructType

    def there(path: str) -> bool:
        at = df.schema
        for part in path.split("."):
            if not isinstance(at, StructType) or part not in at.names:
                return False
            at = at[part].dataType
        return True

    return df.select(*((V.converted(F.col(path), kind) if there(path) else F.lit(None).cast("string")).alias(name) for name, path, kind in columns))
