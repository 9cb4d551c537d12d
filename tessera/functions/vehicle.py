"""Vehicle descriptions: preprocessing, attribute classes, features, checks and scores, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Fixed values that results depend on.
BRAND_ALIASES = {"VW": "VOLKSWAGEN"}
FUEL_WORDS = {"DIESEL": "DIESEL", "GASOLINA": "GASOLINE", "GAS": "GASOLINE", "HYBRID": "HYBRID", "ELECTRIC": "ELECTRIC", "ELÉCTRICO": "ELECTRIC"}
DRIVETRAIN_WORDS = {"4X4": "4X4", "4X2": "4X2", "AWD": "AWD", "FWD": "FWD", "RWD": "RWD"}
BODY_WORDS = {"DC": "DOUBLE_CAB", "SC": "SINGLE_CAB", "SEDAN": "SEDAN", "SUV": "SUV", "HATCHBACK": "HATCHBACK", "PICKUP": "PICKUP", "COUPE": "COUPE", "WAGON": "WAGON"}
FUEL_PARTS = {"DIESEL": "DIESEL", "TD": "DIESEL", "TDI": "DIESEL", "GASOLINA": "GASOLINE", "GASOLINE": "GASOLINE", "GAS": "GASOLINE", "NAFTA": "GASOLINE", "ELECTRIC": "ELECTRIC", "ELECTRICO": "ELECTRIC", "HYBRID": "HYBRID", "HIBRIDO": "HYBRID"}
DRIVETRAIN_PARTS = {"4X4": "4X4", "4WD": "4X4", "AWD": "AWD", "4X2": "4X2", "2WD": "4X2", "FWD": "FWD", "RWD": "RWD"}
BODY_PARTS = {"DC": "DOUBLE_CAB", "DOBLE CABINA": "DOUBLE_CAB", "DOUBLE CAB": "DOUBLE_CAB", "SC": "SINGLE_CAB", "CABINA SIMPLE": "SINGLE_CAB", "SINGLE CAB": "SINGLE_CAB", "SEDAN": "SEDAN", "4P": "SEDAN", "SUV": "SUV", "SPORT UTILITY": "SUV", "HATCHBACK": "HATCHBACK", "5P": "HATCHBACK", "PICKUP": "PICKUP", "CAMIONETA": "PICKUP"}
BODY_INFO = ("DC", "SC", "SEDAN", "SUV", "HATCHBACK", "PICKUP", "CAMIONETA", "DOBLE CABINA", "CABINA SIMPLE", "SPORT UTILITY")
TRIM_INFO = ("DENALI", "PREMIUM", "LUXURY", "SPORT", "LX", "EX", "DX", "LIMITED", "ULTIMATE", "TITANIUM", "PLATINUM")
FUEL_VARIANTS = {"DIESEL": ("DIESEL", "TD", "TDI"), "GASOLINE": ("GASOLINA", "GASOLINE", "GAS", "NAFTA"), "ELECTRIC": ("ELECTRIC", "ELECTRICO"), "HYBRID": ("HYBRID", "HIBRIDO")}
DRIVETRAIN_VARIANTS = {"4X4": ("4X4", "4WD", "AWD"), "4X2": ("4X2", "2WD", "FWD", "RWD")}
BODY_VARIANTS = {"DOUBLE_CAB": ("DC", "DOBLE CABINA", "DOUBLE CAB", "4P", "CB"), "SINGLE_CAB": ("SC", "CABINA SIMPLE", "SINGLE CAB", "2P"), "SEDAN": ("SEDAN", "4P", "4 PUERTAS", "4 DOORS"), "SUV": ("SUV", "SPORT UTILITY"), "HATCHBACK": ("HATCHBACK", "5P", "5 PUERTAS"), "PICKUP": ("PICKUP", "PICK UP", "CAMIONETA")}
ATTRIBUTE_WEIGHTS = {"fuel": 0.30, "drivetrain": 0.25, "body": 0.25, "trim": 0.20}
ABBREVIATIONS = {
    "crossover": "cruzado", "hybrid": "hibrido", "turbo": "turboalimentado", "sport": "deportivo", "hback": "hatchback", "equip": "equipamiento",
    "auto": "automatico", "elec": "electrico", "dies": "diesel", "phev": "hibrido enchufable", "exec": "ejecutivo", "road": "carretera", "conv": "convertible", "crew": "tripulacion", "trim": "version",
    "abs": "sistema antibloqueo", "4x4": "traccion integral", "4wd": "traccion integral", "awd": "traccion integral", "fwd": "traccion delantera", "rwd": "traccion trasera", "bhp": "caballos de fuerza",
    "std": "estandar", "aut": "automatico", "man": "manual", "cvt": "transmision variable continua", "dct": "transmision doble embrague", "pwr": "poder", "gas": "gasolina", "bev": "electrico bateria",
    "ltd": "limitado", "lux": "lujo", "spt": "deportivo", "off": "fuera de carretera", "suv": "vehiculo utilitario deportivo", "mpv": "vehiculo multiproposito", "cab": "cabina", "ext": "extendida",
    "reg": "regular", "dbl": "doble", "sgl": "individual", "2dr": "dos puertas", "4dr": "cuatro puertas", "5dr": "cinco puertas", "pkg": "paquete", "opt": "opcional",
    "ac": "aire acondicionado", "cv": "caballos de fuerza", "hp": "caballos de fuerza", "cc": "centimetros cubicos", "v6": "motor v6", "v8": "motor v8", "v4": "motor v4", "mt": "transmision manual", "at": "transmision automatica", "l": "litros",
}
FEATURES = {
    "transmission": {"manual": ("manual", "mt", "transmision manual"), "automatico": ("automatico", "at", "transmision automatica"), "cvt": ("cvt", "transmision variable continua"), "dct": ("dct", "transmision doble embrague")},
    "fuel_type": {"gasolina": ("gasolina", "gas", "petrol"), "diesel": ("diesel", "dies"), "electrico": ("electrico", "electric", "bev"), "hibrido": ("hibrido", "hybrid", "phev")},
    "drivetrain": {"traccion_delantera": ("fwd", "traccion delantera"), "traccion_trasera": ("rwd", "traccion trasera"), "traccion_integral": ("4x4", "4wd", "awd", "traccion integral")},
    "engine": {"v4": ("v4", "motor v4"), "v6": ("v6", "motor v6"), "v8": ("v8", "motor v8"), "turbo": ("turbo", "turboalimentado")},
    "body_style": {"sedan": ("sedan", "cuatro puertas", "4dr"), "hatchback": ("hatchback", "cinco puertas", "5dr"), "suv": ("suv", "vehiculo utilitario deportivo"), "pickup": ("pickup", "camioneta"), "convertible": ("convertible", "cabrio"), "coupe": ("coupe", "dos puertas", "2dr")},
}
KEYWORDS = ("aire acondicionado", "sistema antibloqueo", "direccion asistida", "asientos piel", "quemacocos", "rines aleacion", "faros niebla")
YEAR = r"\b(?:19|20)[0-9]{2}\b"


def expanded(c: Column) -> Column:
    """Normalised text with its abbreviations written out. The text is cut at its words' bounds once and each word is looked up; no
    abbreviation's long form holds another one, so one pass is enough."""
    long = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    return T.collapse(F.array_join(F.transform(F.split(T.normalize_text(c), r"\b"), lambda w: F.coalesce(F.element_at(long, w), w)), ""))


def features(c: Column) -> dict[str, Column]:
    """Arrays of the features found in an expanded text, by group."""
    found = {g: F.array_compact(F.array(*(F.when(c.rlike("|".join(rf"\b{w}\b" for w in words)), name) for name, words in names.items()))) for g, names in FEATURES.items()}
    return found | {"features": F.array_compact(F.array(*(F.when(c.contains(k), k.replace(" ", "_")) for k in KEYWORDS)))}


def first_word_class(c: Column, words: dict[str, str]) -> Column:
    """The class of the first word of the list that a text holds as a word."""
    return F.coalesce(*(F.when(c.rlike(rf"\b{w}\b"), name) for w, name in words.items()))


def first_part_class(c: Column, parts: dict[str, str]) -> Column:
    """The class of the first part of the list that the upper-case text holds anywhere."""
    return F.coalesce(*(F.when(F.upper(c).contains(w), name) for w, name in parts.items()))


def holds_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.upper(c).contains(p)
    return out


def preprocess(c: Column) -> dict[str, Column]:
    """cleaned, brand, model, year, fuel, drivetrain, body of a description: cleaned, without a doubled first word, without years."""
    clean = undoubled(T.clean_description(c))
    year = T.first_year(clean)
    clean = without_years(clean, year)
    return {"cleaned": clean, "year": year} | parts_of(clean)


def undoubled(clean: Column) -> Column:
    words = F.split(clean, " ")
    return F.when((F.size(words) >= 2) & (words[0] == F.get(words, 1)), F.array_join(F.slice(words, 2, 1_000_000), " ")).otherwise(clean)


def without_years(clean: Column, year: Column) -> Column:
    return F.when(year.isNotNull(), T.collapse(F.regexp_replace(clean, YEAR, ""))).otherwise(clean)


def parts_of(clean: Column) -> dict[str, Column]:
    """brand, model, fuel, drivetrain, body of a cleaned description."""
    words = F.split(clean, " ")
    brand = F.nullif(words[0], F.lit(""))
    alias = F.coalesce(*(F.when(brand == k, v) for k, v in BRAND_ALIASES.items()), brand)
    return {"brand": alias, "model": F.get(words, 1), "fuel": first_word_class(clean, FUEL_WORDS), "drivetrain": first_word_class(clean, DRIVETRAIN_WORDS), "body": first_word_class(clean, BODY_WORDS)}


def allows(constraint: Column, description: Column, variants: dict) -> Column:
    """Whether a description holds a variant of the constraint (or the constraint itself); none allows all."""
    held = F.lit(None).cast("boolean")
    for name, own in variants.items():
        held = F.when(constraint == name, holds_any(description, own)).otherwise(held)
    return F.coalesce(F.when(constraint.isNull(), True), held, F.upper(description).contains(constraint))


def attribute_score(fuel: Column, drivetrain: Column, body: Column, description: Column) -> Column:
    """Weighted share of the attributes that agree among those both sides tell; 0.5 without any, 0.3 where none can be compared."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for value, name, parts, info in ((fuel, "fuel", FUEL_PARTS, FUEL_PARTS), (drivetrain, "drivetrain", DRIVETRAIN_PARTS, DRIVETRAIN_PARTS), (body, "body", BODY_PARTS, BODY_INFO)):
        told = value.isNotNull() & holds_any(description, info)
        total += F.when(told & (first_part_class(description, parts) == value), ATTRIBUTE_WEIGHTS[name]).otherwise(0.0)
        weight += F.when(told, ATTRIBUTE_WEIGHTS[name]).otherwise(0.0)
    return F.when(fuel.isNull() & drivetrain.isNull() & body.isNull(), 0.5).when(weight == 0, 0.3).otherwise(total / weight)


def domain_confidence(score: Column, brand: Column, model: Column, year: Column, completeness: Column, given: Column) -> Column:
    """The score with boosts: 0.1 of a confidence above 0.8 of what was given, 0.05 of completeness, strong components."""
    boosts = F.when(given > 0.8, 0.1 * given).otherwise(0.0) + 0.05 * completeness
    for part, boost in ((brand, 0.05), (model, 0.05), (year, 0.03)):
        boosts += F.when(part >= 0.9, boost).otherwise(0.0)
    return F.least(F.lit(1.0), score + boosts)
