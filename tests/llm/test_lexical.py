"""Ranked lexical search against a plain program over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import lexical

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id long, no long, n long, df long, rank string, score string"


def terms(t):
    return [x.lower() for x in TERM.findall((t or "").encode())]


def brute(docs, items, k):
    tf = [(d, Counter(terms(t))) for d, t in docs]
    tf = [(d, c, sum(c.values())) for d, c in tf if c]
    n_docs, total = len(tf), sum(n for _, _, n in tf)
    df = Counter(x for _, c, _ in tf for x in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in tf:
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in set(terms(text)) if x in c)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k, **more):
    df = spark.createDataFrame([(d, t, 1, 1, 1, 1, "x", "y") for d, t in docs], DOCS)
    asked = spark.createDataFrame([(i, t, 7, "z") for i, t in items], "item_id long, text string, doc_id long, terms string")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(lexical.index(df), asked, k, **more).collect()), key=repr)


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    return [" ".join(rng.choices(vocab, weight, k=rng.randint(0, 80))) for _ in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 64)  # several segments a task
    monkeypatch.setattr(lexical, "WIDTH", 4)
    rng = random.Random(1)
    texts = corpus(rng, 300)
    texts += [texts[0]] * 90 + [None, "", " .-", "W1 w1 É", "w2 " * 30_000]  # more ties than places, and a very long text
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = [*zip(ids, texts, strict=True), (None, texts[1]), (5, texts[2]), (5, texts[2])]
    items = [(0, texts[0]), (1, "w1 W1 w59 nowhere"), (2, None), (3, ""), (None, "w3"), (4, "nowhere"), (4, "w5 w6"), (5, " ".join(f"w{i}" for i in range(60)))]
    want = brute(docs, items, 50)
    assert found(spark, docs, items, 50) == want
    assert found(spark, docs, items, 50, block=3) == want  # a block for each item or so


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")], 5) == [] == found(spark, [(1, "a")], [], 5) == found(spark, [(1, None)], [(1, "a")], 5)


def test_range_maxima():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 9, 200)
    t = lexical.sparse_table(v, 200)
    for a in range(0, 200, 7):
        for z in range(a + 1, 201, 5):
            j = (z - a).bit_length() - 1
            x, y = t[j][a], t[j][z - (1 << j)]
            assert (x if v[x] >= v[y] else y) == a + v[a:z].argmax()


def test_terms_of_long_texts():
    rng = random.Random(3)
    texts = [" ".join(f"t{rng.randrange(50)}" for _ in range(2_500_000)), "t1 t1", None]  # more than a slice
    names, term, row, n = lexical.term_counts(__import__("pyarrow").array(texts))
    got = {(names[int(t)].as_py().encode(), int(r)): int(c) for t, r, c in zip(term, row, n, strict=True)}
    assert got == {(x, i): c for i, t in enumerate(texts) for x, c in Counter(terms(t)).items()}
