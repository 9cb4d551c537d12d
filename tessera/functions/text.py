"""Text functions of the codification pipeline, as Column expressions that stay in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
NULL_WORDS = ("nan", "null", "none", "")
ABSENT_WORDS = ("n/a", "na", "no aplica", "no disponible")
STOP_WORDS = ("DE", "LA", "EL", "EN", "CON", "Y", "O", "DEL")


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into one letter and combining marks, with that letter for each; then the marks themselves."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1:
            pairs.append((c, plain))
    return "".join(c for c, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(p for _, p in pairs)


#: Each letter of ACCENTED becomes the one at its place in PLAIN; those beyond its end, the marks, go.
ACCENTED, PLAIN = _accents()


def deburr(c: Column) -> Column:
    """Letters without their accents; letters that have no decomposition (ß, æ, ø) stay."""
    return F.translate(c, ACCENTED, PLAIN)


def ascii_letters(c: Column) -> Column:
    """deburr, and the letters without a decomposition by their usual spelling."""
    for letter, spelling in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("ø", "o"), ("Ø", "O"), ("œ", "oe"), ("Œ", "OE")):
        c = F.replace(c, F.lit(letter), F.lit(spelling))
    return deburr(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, ASCII letters, marks but . and - as spaces, single spaces; null is ''."""
    c = ascii_letters(F.lower(F.trim(F.coalesce(c, F.lit("")))))
    return collapse(F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F]", ""), r"[^A-Za-z0-9_\s.\-]", " "))


def clean_value(c: Column) -> Column:
    """Null for the words that mean no value, else the text with single spaces."""
    bare = F.trim(c)
    one = collapse(bare)
    return F.when(F.lower(bare).isin(*NULL_WORDS) | F.lower(one).isin(*ABSENT_WORDS), None).otherwise(one)


def clean_description(c: Column) -> Column:
    """Upper case, letters, digits and _ of any script, single spaces."""
    return collapse(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "))


def search_tokens(c: Column) -> Column:
    """The words of a cleaned description, without stop words and single letters."""
    return F.filter(F.split(clean_description(c), " "), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1))


def first_year(c: Column) -> Column:
    """The first four digits that look like a year of 1900-2099, as an int."""
    return F.regexp_extract(c, r"\b((?:19|20)[0-9]{2})\b", 1).try_cast("int")


def bounded_year(c: Column, low: int = 1900, high: int = 2025) -> Column:
    y = first_year(c)
    return F.when(y.between(low, high), y)


def parse_currency(c: Column) -> Column:
    """Digits, commas and points alone, commas read as points; null where that is no number."""
    return F.replace(F.regexp_replace(c, r"[^0-9.,]", ""), F.lit(","), F.lit(".")).try_cast("double")


def year_code(c: Column) -> Column:
    """Model-year codes: 1900-2030 and 2031-2099 as they are, 1400-1499 as 2000 and on, else null."""
    n = c.try_cast("int")
    return F.when(n.between(1900, 2099), n).when(n.between(1400, 1499), n + 600)


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.upper(c), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays of distinct words, 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity(a: Column, b: Column, inside: float, boost: float = 1.0, most: float = 1.0) -> Column:
    """1 if equal, `inside` if one holds the other, else Jaccard of their words times boost, at most `most`; a null is 0."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    words = F.least(F.lit(most), jaccard(words_of(x), words_of(y)) * boost)
    return F.when(x.isNull() | y.isNull() | (x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), inside).otherwise(words)


def vin_errors(c: Column) -> Column:
    """Messages about a vehicle identification number: 17 characters, then no I, O, Q, then letters and digits."""
    v = F.upper(F.replace(c, F.lit(" "), F.lit("")))
    wrong = F.array(F.when(v.rlike("[IOQ]"), "VIN contains I, O or Q"), F.when(~F.replace(v, F.lit("-"), F.lit("")).rlike("^[A-Z0-9]*$"), "VIN must be alphanumeric"))
    return F.when(v.isNull() | (v == ""), F.array().cast("array<string>")).when(F.length(v) != 17, F.array(F.lit("VIN must be 17 characters"))).otherwise(F.array_compact(wrong))


def case_level(c: Column, high: float, medium: float, low: float) -> Column:
    """Confidence level; bounds are inclusive below."""
    return F.when(c >= high, "high").when(c >= medium, "medium").when(c >= low, "low").otherwise("very_low")
