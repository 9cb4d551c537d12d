"""The corpus operators against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, common, decontaminate, exact_dedup, jaccard_join, katz, language, line_dedup, pii, token_files, toxicity
from tessera.llm.tokenizer import ForcedBoundaryBpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, pivot int"


def docs(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 60))) for _ in range(n)]
    for i in range(0, n, 3):
        own = out[i].split()
        own[rng.randrange(len(own))] = "changed"
        out.append(" ".join(own))
    return [*out, None, "", " \n\t", "one", "One", "one two", "ONE two", out[0], out[0].upper(), "É x", "é x"]


def fold(t):
    return "".join(c.lower() if c < "\x80" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", fold(t))


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_word_hashes():
    texts = ["a  b\tc", "", None, "A B", "x" * 3_000_000 + " a", "é a"]
    h, at = common.words(pa.array(texts))
    assert list(np.diff(at)) == [3, 0, 0, 2, 2, 2]
    assert h[0] == h[3] == h[at[4] + 1] == h[at[5] + 1] and len(set(h)) == 5


def test_exact_dedup(spark):
    texts = corpus()
    for size in (32, 1):  # a digest of one byte collides: the check of full bytes takes the texts apart
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(spark, texts), size).collect()}
        groups = defaultdict(list)
        for i, t in enumerate(texts):
            groups[fold(t)].append(i)
        for key, ids in groups.items():
            for i in ids:
                r = got[i]
                assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
                assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, k, percent):
    texts = corpus()
    sets = [shingle_set(t, k) for t in texts]
    comp = list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs(spark, texts), k, percent).collect()}
    assert got == {i: (len(sets[i]), root(i)) for i in range(len(texts))}
    assert jaccard_join.jaccard_components(docs(spark, []), k, percent).count() == 0


def test_contained(spark):
    texts = corpus()
    items = [(0, " ".join(words(texts[0])[2:14]), "x"), (1, "one two", "x"), (2, None, "x"), (None, texts[1], "x"), (3, " ".join(words(texts[3])[:9] + ["else"]), "x")]
    table = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    own = {i: {tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)} for i, t, _ in items if i is not None}
    want = {(d, i) for d, t in enumerate(texts) for i, s in own.items() if s and 100 * len(s & {tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)}) >= 80 * len(s)}
    for block in (2_000_000, 5):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs(spark, texts), table, block=block).collect()} == want
    assert decontaminate.contained(docs(spark, texts), table.limit(0)).count() == 0


LETTERS = ["ab", "Σ", "É", "1", "'s", "!!", "  ", "\n", "\x1c", "<|endoftext|>", "thing", "日本", "😀", "́", "ß", "İ", "don't", "\x01"]


def test_bpe_and_token_files(spark, tmp_path):
    path = public_tokenizers.path(bpe.VOCABULARY)
    library, own = Tokenizer.from_file(path), ForcedBoundaryBpe(path)
    rng = random.Random(2)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 9))) for _ in range(500)] + [None, "", "a" * 50_000]
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = {r.doc_id: r for r in bpe.encode(docs(spark, texts)).collect()}
    for i, want in enumerate(ids):
        assert got[i].ids == want and got[i].decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)
    out = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs(spark, texts), out)
    back, start = {r.doc_id: r for r in token_files.read_tokens(spark, out).collect()}, 0
    for i, want in enumerate(ids):
        assert (back[i].start, back[i].ids) == (start, [*want, 2])
        start += len(want) + 1
    assert [r.start for r in token_files.read_tokens(spark, out, 7, 7).collect()] == [back[7].start]


def test_pii(spark):
    text = "call me, IBAN DE89370400440532013000 ssn 123-45-6789 x@y.z 1.2.3.4 300.1.1.1, 4111 1111 1111 1111 +1 (743) 555-3824"
    got = {r.doc_id: r for r in pii.find_pii(docs(spark, [text, None, "", "1" * 50_000, "a.b-" * 10_000])).collect()}
    found = {k.name: [text[s.start : s.end] for s in got[0][f"{k.name}_spans"]] for k in pii.KINDS}
    assert found == {"email": ["x@y.z"], "ip": ["1.2.3.4"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (743) 555-3824"], "iban": ["DE89370400440532013000"], "ssn": ["123-45-6789"]}
    assert all(not got[i][f"{k.name}_spans"] for i in range(1, 5) for k in pii.KINDS)


def test_toxicity(spark):
    a = toxicity.Automaton(["idiot", "^lowe", "worthless", "scum"])
    assert [a.match(w) for w in ("idiot", "idiott", "idot", "lowexyz", "scumm", "wrthles", "xdiot", "the")] == [1, 2, 2, 1, 2, 2, 2, 0]
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(12)) + (" you idiot" if i % 2 else "") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs(spark, texts), labels, ~toxicity.fold(5, 0))
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs(spark, [*texts, None, "", "you idiott"]), model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(80)) and got[80] < 0.5 and got[81] < 0.5 and got[82] >= 0.5
    none = toxicity.fit(docs(spark, texts), labels.limit(0), ~toxicity.fold(5, 0))
    assert {r.score < 1e-9 for r in toxicity.score_toxicity(docs(spark, texts), none).collect()} == {True}


def test_forward_backward():
    rng = np.random.default_rng(0)
    e, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        weight = math.exp(sum(e[0, i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            want[i, y] += weight
    p, _ = language.forward_backward(e, np.ones((1, 4), bool), t)
    assert np.allclose(p[0], want / want.sum(axis=1, keepdims=True))


def test_language(spark):
    rng = random.Random(4)
    make = lambda lang: " ".join("".join(rng.choice({"en": ["th", "er", "ing"], "de": ["sch", "ung", "ä"]}[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["en", "de"] * 30)] + [(60, None, "en"), (61, "12 34", None), (62, "", "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(table, language.fit(table, ~toxicity.fold(4, 2))).collect()}
    assert [got[i] for i in range(60)] == ["en", "de"] * 30 and got[60] == got[61] == got[62] == "und"


def test_line_dedup(spark):
    rng = random.Random(5)
    lines = [" ".join(f"x{rng.randint(0, 99)}" for _ in range(rng.randint(1, 5))) for _ in range(12)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 14))) for _ in range(25)] + [None, "", "\n\n"]
    least, seen, want = 8, {}, set()
    for i, t in enumerate(texts):
        own = [x for x in (t or "").split("\n") if x.strip()]
        for a in range(len(own)):
            for b in range(a, len(own)):
                seen.setdefault(tuple(own[a : b + 1]), (i, a))
    for i, t in enumerate(texts):
        own = [x for x in (t or "").split("\n") if x.strip()]
        for a in range(len(own)):
            for b in range(a, len(own)):
                if sum(len(x.split()) for x in own[a : b + 1]) >= least and seen[tuple(own[a : b + 1])] < (i, a):
                    want |= {(i, j) for j in range(a, b + 1)}
    assert {(r.doc_id, r.line) for r in line_dedup.repeated_lines(docs(spark, texts), least).collect()} == want
    assert line_dedup.dedup_lines(docs(spark, texts), least).count() == len(texts)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [t for t in corpus(30) if t is not None]
    sf = str(tmp_path)
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    item = " ".join(words(texts[4])[:12])
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    last = {fold(t): i for i, t in enumerate(texts)}
    left = sorted(last.values())
    sets, comp = {i: shingle_set(texts[i], 5) for i in left}, {i: i for i in left}
    for _ in left:
        for i in left:
            for j in left:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    own = shingle_set(item, 5)
    want = {i for i in left if comp[i] == i and 100 * len(own & sets[i]) < 80 * len(own)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_parity_bits_never_exceed_the_difference():
    import numpy as np

    from tessera.llm.jaccard_join import parity

    r = np.random.default_rng(3)
    for n, m in ((0, 0), (0, 5), (40, 38), (300, 300), (5000, 4000)):
        pool = r.integers(0, 1 << 63, n + m + 1, dtype=np.uint64)
        x, y = np.unique(r.choice(pool, n)), np.unique(r.choice(pool, m))
        a, b = (np.frombuffer(parity(v), np.uint8) for v in (x, y))
        assert np.bitwise_count(a ^ b).sum(dtype=np.int64) <= len(np.setxor1d(x, y))
