"""IBANs before upper-case words, numbers and other IBANs."""

from tessera.llm import pii


def test_iban_layouts(spark):
    a, b, c = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "KZ86 125K ZT50 0410 0100"
    texts = [f"IBAN {a} BIC COBADEFFXXX", f"{b} EUR 250", f"{a} GB82WEST12345698765432 {c} X", f"ä {c}", f"{a}x {a}1", f"{a[:-1]}1 BIC", f"{a} Bank", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.iban_spans] for r in pii.find_pii(docs).collect()}
    assert got == {0: [a], 1: [b], 2: [a, "GB82WEST12345698765432", c], 3: [c], 4: [], 5: [], 6: [a], 7: []}
