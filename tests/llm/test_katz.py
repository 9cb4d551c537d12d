"""Katz backoff against brute force, with every word of the head, and with most words and contexts outside of it or spread."""

import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import katz, toxicity
from tests.llm.test_operators import corpus, docs, words


def model(toks, held):
    """(p, unknown, bigram counts, discounts of them, denominators, alphas, unigram counts) by plain counting."""
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    b = Counter(p for t, h in zip(toks, held, strict=True) if not h for p in zip(["<s>", *t[:-1]], t))
    n = sum(c.values())
    d1, d2 = (katz.discounts(Counter(x.values())) for x in (c, b))
    dis = lambda r, d: d[r - 1] * r if r <= katz.CUT else r
    p = {w: dis(r, d1) / n for w, r in c.items()}
    unknown = 1 - sum(p.values())
    after = defaultdict(list)
    for (h, w), r in b.items():
        after[h].append((w, r))
    below, alpha = {}, {}
    for h, own in after.items():
        total, kept = sum(r for _, r in own), sum(dis(r, d2) for _, r in own)
        below[h] = total if kept < total - 1e-9 else total + 1
        alpha[h] = (1 - kept / below[h]) / (1 - sum(p[w] for w, _ in own))
        mass = kept / below[h] + alpha[h] * (unknown + sum(q for w, q in p.items() if (h, w) not in b))
        assert abs(mass - 1) < 1e-9  # exactly normalised
    return p, unknown, {k: dis(r, d2) for k, r in b.items()}, below, alpha, c


@pytest.mark.parametrize("head,bucket,repeated", [(katz.HEAD, katz.BUCKET, False), (12, 40, True), (3, 40, False)])
def test_katz(spark, head, bucket, repeated):
    texts = corpus(30)
    ids = [i // 2 if repeated else i for i in range(len(texts))]
    if repeated:
        texts, ids = [*texts, texts[0], "of no id"], [*ids, ids[0], None]
    got = sorted(katz.score(docs(spark, texts, ids), toxicity.fold(7, 2), head, bucket).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.score))
    toks = [[*words(t), "</s>"] for t in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    p, unknown, dis, below, alpha, c = model(toks, held)
    n, v, want = sum(c.values()), len(c), []
    for i, t, h in zip(ids, toks, held, strict=True):
        s = sum(math.log10(dis[x] / below[x[0]]) if x in dis else math.log10(alpha.get(x[0], 1)) + math.log10(p.get(x[1], unknown)) for x in zip(["<s>", *t[:-1]], t))
        want.append((i, s, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), len(t), sum(c[w] > 0 for w in t), h))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(want)
    for r, (i, s, base, size, known, h) in zip(got, want, strict=True):
        assert abs(r.score - s) < 1e-8 and abs(r.base_score - base) < 1e-8
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (i, size, known, n, h)


def test_empty_and_all_held_out(spark):
    assert katz.score(docs(spark, []), toxicity.fold(7, 2)).count() == 0
    got = {r.doc_id: r for r in katz.score(docs(spark, ["a b", None]), F.lit(True)).collect()}
    assert [(got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].base_score, got[i].score) for i in (0, 1)] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_packed_numbers():
    rng = random.Random(1)
    a = [katz.np.array([rng.randrange(-(1 << 63), 1 << 63) >> rng.randrange(60) for _ in range(n)], katz.np.int64) for n in (50, 50)]
    assert (katz.unpack(katz.pack(*a), 2) == katz.np.stack(a)).all()


def test_counts_of_head_words_are_not_packed():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(30)) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts), "key": pa.array(range(50), pa.int64()), "held_out": pa.array([i % 3 == 0 for i in range(50)])})
    tok, count = katz.np.unique(katz._tokens(batch)[2], return_counts=True)
    head = {t: i for i, t in enumerate(tok.tolist()) if i % 4}  # every fourth word is outside the head
    rank = katz.np.full(len(tok), 0)
    rank[list(head.values())] = range(len(head))
    ids = lambda x: katz.np.array([rank[head[t]] if t in head else t - (1 << 64 if t >> 63 else 0) | int(katz.FAR) for t in x.tolist()], katz.np.int64)
    u = SimpleNamespace(ids=ids, count=count[list(head.values())], share=katz.np.ones(len(head), katz.np.int64))
    out = pa.Table.from_batches(katz._common(SimpleNamespace(value=u), 1)(iter([batch])))
    assert not katz.unpacked(out.column("blob"), 5)[4].any()
    h, key, n, c, at, trained, new = katz._bucket(out.column("blob"), u.count)
    text, ctx, token = katz._tokens(batch)
    want = Counter(zip(text.tolist(), ids(ctx).tolist(), ids(token).tolist(), strict=True))
    want = sorted((k, a, m, int(u.count[w])) for (k, a, w), m in want.items() if w >= 0)
    assert sorted(zip(key.tolist(), h.tolist(), n.tolist(), c.tolist(), strict=True)) == want
