"""The automaton against a plain dynamic program, lexicons of rare terms, copies as no evidence, and the effects of hits."""

import random

import numpy as np

from tessera.llm import toxicity
from tests.llm.test_operators import docs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_dynamic_program():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [make(rng.randint(3, 10)) for _ in range(6)] + ["^" + make(rng.randint(4, 7)) for _ in range(3)]
    strict = frozenset(terms[:1])
    a = toxicity.Automaton(terms, strict)

    def code(w):
        best = 0
        for t in terms:
            stem, own = t[0] == "^", t.lstrip("^")
            most = 0 if t in strict or len(own) < (6 if stem else 4) else 1 if stem or len(own) < 9 else 2
            d = min(distance(w[:i], own) for i in range(len(w) + 1)) if stem else distance(w, own)
            if d <= most:
                best = 1 if d == 0 or best == 1 else 2
        return best

    for _ in range(3000):
        w = rng.choice(terms).lstrip("^") if rng.random() < 0.7 else make(rng.randint(1, 11))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice((w[:i] + rng.choice("abc") + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice("abc") + w[i + 1 :]))
        assert a.match(w) == code(w), w


def test_rare_terms_and_copies(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    terms = ["z" + make(7) for _ in range(40)]
    text = lambda: " ".join(make(rng.randint(3, 6)) for _ in range(12))
    copied = "qqqone qqqtwo qqqthree " + text()  # words of one text that was copied are no evidence
    rows = [f"{text()} {terms[i % 40]} {text()}" if i < 640 else text() for i in range(3800)] + [copied] * 40  # a term is in one of 40 toxic texts
    labels = spark.createDataFrame([(i, int(i < 640 or i >= 3800)) for i in range(len(rows))], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), labels, ~toxicity.fold(5, 0))
    assert set(terms) <= set(model.terms) and not any(t.startswith(("qqq", "^qqq")) for t in model.terms)
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, [terms[0], "x" + terms[0][1:], f'"{terms[0]}" he said "', "", None]), model).collect()}
    assert scores[0] >= scores[1] > scores[2] >= scores[3] == scores[4] and scores[1] >= 0.5 > scores[2]


def test_hits_never_lower_a_score():
    rng = np.random.default_rng(3)
    hits = np.column_stack([rng.integers(0, 3, 400), rng.integers(0, 3, 400), rng.integers(0, 3, 400), np.full(400, 50)])
    w = toxicity.logistic(toxicity.features(hits), (rng.random(400) < 0.5).astype(float))
    assert (w[1:] >= 0).all()


def test_cases(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, ["a"]), none, ~toxicity.fold(5, 0))
    assert toxicity.score_toxicity(docs(spark, []), model).count() == 0
    got = toxicity.score_toxicity(docs(spark, ["a", "a", None, "x " * 100_000], [None, 1, 1, 2]), model).collect()
    assert len(got) == 4 and all(r.score < 0.5 for r in got)
