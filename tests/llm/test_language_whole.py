"""More languages than LANGUAGES: none is left out."""

import random

from pyspark.sql import functions as F

from tessera.llm import language


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    n = language.LANGUAGES + 6
    own = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for _ in range(n)]
    rows = [(i, " ".join("".join(rng.choice(own[i % n]) for _ in range(3)) for _ in range(20)), f"l{i % n:03}") for i in range(4 * n)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(table, F.lit(True), 3)
    assert model.languages == [f"l{i:03}" for i in range(n)]
    got = {r.doc_id: r.lang_pred for r in language.identify(table, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows if i % n >= language.LANGUAGES)
