"""Importance resampling against a plain program, and the open-addressed table against Python's own dictionaries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import ngrams, resample
from tessera.llm.common import buffers

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CLASHING = "doc_id long, text string, place long, rank long, can boolean, n_words long, bucket long, _part int, _offset long"


def words(t):
    return WORD.findall((t or "").encode().lower())


def features(t):
    w = words(t)
    return w + [x + b" " + y for x, y in zip(w, w[1:], strict=False)]


def corpus(n=80, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["a", "Bc", "x" * rng.randint(1, 50), "é-ü", "1.2", "日本", "\x1c"]) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [None, "", " .\n", "one", "z" * 40_000]


def brute(rows, target, buckets, percent, least):
    s, t = ([0] * buckets for _ in range(2))
    for table, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for f in features(x):
                table[zlib.crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    out, can = [], []
    for d, x in rows:
        f = features(x)
        weight = sum(gain[zlib.crc32(v) % buckets] for v in f) // len(f) if f else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words(x)) >= least:
                can.append((-score, d))
        out.append((d, len(f), weight, score))
    drawn = sorted(can)[: percent * len(can) // 100]
    return out, drawn


def test_against_brute_force(spark):
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3]), (3, texts[4])]
    target = ["a bc a bc é", None, "日本 1 2", ""]
    df = spark.createDataFrame([(d, t, 0, 0, True, 0, 0, 0, 0) for d, t in rows], CLASHING)
    items = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = resample.resample(df, items, buckets=97).collect()
    want, drawn = brute(rows, target, 97, 25, 20)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == sorted(want, key=repr)
    ranked = sorted((r.rank, -r.score, r.doc_id) for r in got if r.rank is not None)
    assert [r for r, _, _ in ranked] == list(range(1, len(drawn) + 1)) and [x[1:] for x in ranked] == drawn


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(none, items).count() == 0
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert [(r.n_features, r.rank) for r in resample.resample(some, items).collect()] == [(59, None)]


def test_table_of_slots():
    texts = corpus(200, 2)
    data, bounds = buffers(pa.array(texts))
    for size in (1 << 20, 64, 7):  # slices end within texts and between any two words
        got = {}
        for buf, s, e, row, fresh in ngrams.word_slices(data, bounds, 1, size):
            s, e, row = ngrams.runs_of(s, e, row, fresh, 2)
            raw = [buf[x:y].tobytes() for x, y in zip(s, e, strict=True)]
            key = ngrams.xxhash64(buf, s, e)
            assert key.tolist() == [xxhash.xxh64_intdigest(x) for x in raw] and ngrams.crc32(buf, s, e).tolist() == [zlib.crc32(x) for x in raw]
            for table in (ngrams.Slots(buf, s, e), ngrams.Slots(buf, s, e, keys=key & np.uint64(1))):  # the second: two keys for all
                assert [buf[table.start[i] : table.end[i]].tobytes() for i in table.of] == raw
                assert {buf[a:z].tobytes(): n for a, z, n in zip(table.start, table.end, table.count.tolist(), strict=True)} == Counter(raw)
            for x, r in zip(raw, row.tolist(), strict=True):
                got.setdefault(r, []).append(x)
        assert all(sorted(got.get(i, [])) == sorted(features(t)) for i, t in enumerate(texts))
