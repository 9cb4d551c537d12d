"""Personal data in texts, with DataFrame functions alone: regular expressions propose, checksums confirm, context scores.

For each kind the text is split at the pattern, so the lengths of the gaps and of the matches give every match's place in
code points. Cards must pass Luhn, IBANs mod 97 (an IBAN's pattern takes its first
four characters and looks ahead; the span is the longest part from there to the end of a word that passes), IP parts must be at most 255, phones need 9 to 15 digits. A span's score
starts at its kind's and gains where one of the kind's context words stands within WINDOW characters before or behind it.
Spans of the base kinds always stay; a kind of the method's own (iban, ssn) stays where its score reaches THRESHOLD: an
IBAN by its checksum, a social security number by its context alone. The patterns cannot backtrack into long runs
(possessive repeats, starts only at the start of a run), so a very long text takes time in proportion to its length.

Defined cases: a null or empty text has no spans and the digest of the empty string; repeated rows give their own rows;
a null doc_id is kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts

WINDOW, THRESHOLD, GAIN = 40, 0.6, 0.3


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    score: float
    context: tuple[str, ...] = field(default=())
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.7, ("mail", "e-mail", "contact", "write", "correo", "courriel", "kontakt")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, ("ip", "host", "server", "address", "dirección", "adresse")),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12,}+", 0.7, ("card", "visa", "credit", "tarjeta", "carte", "karte", "payment")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, ("phone", "call", "tel", "mobile", "fax", "teléfono", "telefon", "téléphone")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", 0.6, ("iban", "account", "konto", "cuenta", "compte", "bank"), base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, ("ssn", "social", "security", "taxpayer"), base=False),
)
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    back = F.split(F.reverse(digits), "")
    double = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(double, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes mod 97; letters count as two digits from A = 10 on."""
    turned = F.split(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), "")
    code = lambda c: F.ascii(c)
    step = lambda a, c: F.when(code(c) >= 65, a * 100 + code(c) - 55).otherwise(a * 10 + code(c) - 48) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def longest_iban(head: Column, tail: Column) -> Column:
    """The longest part of head and tail that ends at the end of a word and is an IBAN, or null. A tail has one character
    more where its last word goes on, which makes that word too long or of the wrong case."""
    words = F.split(F.concat(head, tail), " ")
    parts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    valid = F.filter(parts, lambda c: bare(c).rlike("^[A-Z0-9]{15,34}$") & mod97(bare(c)))
    return F.try_element_at(valid, F.lit(-1))


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(f"^{PART}\\.{PART}\\.{PART}\\.{PART}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def find(kind: Kind, text: Column) -> Column:
    """array<struct<start int, end int, score double>> of the kind's spans, in order."""
    matches, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,score:double>>")
    words = "|".join(kind.context)

    # matches and gaps are worked out once, as the only element of an array
    tails = [F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)).alias("t")] if kind.name == "iban" else []
    both = F.array(F.struct(matches.alias("m"), gaps.alias("g"), *tails))
    if tails:
        return F.when(text.rlike(kind.pattern), F.element_at(F.transform(both, lambda x: iban_spans(kind, x, empty)), 1)).otherwise(empty)

    def spans(x: Column) -> Column:
        def bound(acc: Column, i: Column) -> Column:
            match, before, behind = F.element_at(x["m"], i), F.element_at(x["g"], i), F.element_at(x["g"], i + 1)
            start = acc["pos"] + F.length(before)
            end = start + F.length(match)
            near = F.lower(F.concat(F.right(before, F.lit(WINDOW)), F.lit(" "), F.left(behind, F.lit(WINDOW))))
            score = F.lit(kind.score) + F.when(near.rlike(rf"(?<![\p{{L}}])(?:{words})"), F.lit(GAIN)).otherwise(F.lit(0.0))
            ok = confirmed(kind.name, match) & (F.lit(kind.base) | (score >= THRESHOLD))
            span = F.array(F.struct(start.alias("start"), end.alias("end"), score.alias("score")))
            return F.struct(end.alias("pos"), F.when(ok, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(x["m"])), zero, bound, lambda acc: acc["out"])

    return F.when(text.rlike(kind.pattern), F.element_at(F.transform(both, spans), 1)).otherwise(empty)


def iban_spans(kind: Kind, x: Column, empty: Column) -> Column:
    """The spans of IBANs from the heads m, what may follow them t, and the gaps g; a span within an earlier one is none."""
    words = "|".join(kind.context)

    def span(i: Column, start: Column, found: Column) -> Column:
        over = F.length(found) - F.length(F.element_at(x["m"], i))  # of the gap behind, what the span takes
        near = F.lower(F.concat(F.right(F.element_at(x["g"], i), F.lit(WINDOW)), F.lit(" "), F.substr(F.element_at(x["g"], i + 1), over + 1, F.lit(WINDOW))))
        score = F.lit(kind.score) + F.when(near.rlike(rf"(?<![\p{{L}}])(?:{words})"), F.lit(GAIN)).otherwise(F.lit(0.0))
        return F.struct(start.alias("start"), (start + F.length(found)).alias("end"), score.alias("score"))

    def bound(acc: Column, i: Column) -> Column:
        head = F.element_at(x["m"], i)
        start = acc["pos"] + F.length(F.element_at(x["g"], i))
        found = longest_iban(head, F.element_at(x["t"], i))
        ok = found.isNotNull() & (start >= acc["free"])
        own = F.when(ok, F.array(span(i, start, found))).otherwise(empty)
        return F.struct((start + F.length(head)).alias("pos"), F.when(ok, start + F.length(found)).otherwise(acc["free"]).alias("free"), F.concat(acc["out"], own).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("free"), empty.alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(x["m"])), zero, bound, lambda acc: acc["out"])


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, and for each kind the array `<kind>_spans` of (start, end, score)."""
    return texts(docs).select("doc_id", *[find(k, F.col("text")).alias(f"{k.name}_spans") for k in KINDS])


def joined(kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end of all spans, comma-joined, kinds in order and then by start."""

    def named(kind: Kind) -> Column:
        return F.transform(f"{kind.name}_spans", lambda s: F.concat_ws(":", F.lit(kind.name), s["start"].cast("string"), s["end"].cast("string")))

    parts = [named(k) for k in kinds]
    return F.array_join(F.concat(*parts), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = tuple(k for k in KINDS if k.base)
    counts = [F.size(f"{k.name}_spans").cast("long").alias(f"n_{k.name}") for k in base]
    scores = F.round(F.aggregate(F.concat(*[f"{k.name}_spans" for k in KINDS]), F.lit(0.0), lambda a, s: a + s["score"]), 6)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(KINDS).alias("spans"), scores.alias("score_sum"))
