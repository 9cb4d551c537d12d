"""Language identification: a linear-chain CRF labels every word, by forward-backward, also in code-switched text.

A word's features are its affixes, its character n-grams and itself as an entry of the lexicon, hashed to DIMENSIONS
weights for each language; transitions between neighbours' languages are learned with them. The model is fitted by
gradient steps on the exact CRF likelihood over a bounded sample: at most SAMPLE documents of each language (smallest hash
of doc_id; fewer of each where there are more than LANGUAGES, so that the total is bounded and no language is left out), one run of TRAIN_WORDS words from each; half of the training chains join runs of two languages, so switching is
seen. For prediction each whole text is cut into chains of CHAIN words (the last one shorter); forward-backward gives each
word's distribution, and the text's language is the one with the largest mean over the words with a letter; that mean is
the score.

Defined cases: a null text or one without letters is `und` with score 0; without any labelled row all texts are `und`;
null labels are no labels; repeated rows give their own rows; a null doc_id is kept and is no training row; other
columns are ignored; an empty table gives no rows. Very long texts are handled chain by chain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, texts, written
from .toxicity import fold

#: Bounds: documents of each language in the sample, fewer where there are more than LANGUAGES (their total is that of so many);
#: weights for each language, words a task remembers. Every language is learned.
SAMPLE, LANGUAGES, DIMENSIONS, CACHE = 1_500, 64, 1 << 15, 300_000
CHAIN, TRAIN_WORDS, STEPS = 64, 24, 40
#: Chains times languages that are worked on at a time.
CELLS = 1 << 16
#: Letters around a word that are none of it; the hash of the mark of whole words.
STRIPPED, WHOLE = ".,;:!?\"'()[]|*&%$#", zlib.crc32(b"w")


def _tables(mark: bytes, n: int) -> list[np.ndarray]:
    """The hash of mark and n bytes as a table for each byte, to be joined by exclusive or: a CRC is linear in its bits."""
    base = zlib.crc32(mark + bytes(n))
    of = [[zlib.crc32(mark + bytes(i) + bytes([b]) + bytes(n - 1 - i)) ^ (base if i else 0) for b in range(256)] for i in range(n)]
    return [np.array(x, np.int64) & (DIMENSIONS - 1) for x in of]


TABLES = {(mark, n): _tables(mark, n) for mark, n in ((b"p", 3), (b"p", 4), (b"s", 3), (b"s", 4), (b"", 2), (b"", 3))}


def _hashed(mark: bytes, n: int, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hashes of mark and the n bytes from each place."""
    t = TABLES[mark, n]
    out = t[0][text[at]]
    for i in range(1, n):
        out ^= t[i][text[at + i]]
    return out


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, feature) of the hashed features of words, all of one kind together; none for a word without a letter. No word
    holds white space."""
    w = [x.strip(STRIPPED) for x in "\n".join(words).lower().split("\n")]
    place = np.array([i for i, x in enumerate(w) if x.isalpha() or any(map(str.isalpha, x))], dtype=np.int64)
    if not len(place):
        return place, place
    own = [f"<{w[i]}>".encode() for i in place.tolist()]
    text = np.frombuffer(b"\n".join(own), np.uint8)
    ends = np.append(np.flatnonzero(text == 10), len(text))
    begin = np.append(0, ends[:-1] + 1)
    short = ends - begin < 4
    out = [(place, np.array([zlib.crc32(x, WHOLE) for x in own], dtype=np.int64) & (DIMENSIONS - 1))]
    for mark, three, four in ((b"p", begin, begin), (b"s", ends - 3, ends - 4)):
        out.append((place, h := _hashed(mark, 3, text, three)))
        h = h.copy()
        h[~short] = _hashed(mark, 4, text, four[~short])
        out.append((place, h))
    of = np.repeat(place, np.diff(np.append(begin, len(text) + 1)))[: len(text)]
    inside = text != 10
    two = inside[:-1] & inside[1:]
    for n, at in ((2, np.flatnonzero(two)), (3, np.flatnonzero(two[:-1] & inside[2:]))):
        out.append((of[at], _hashed(b"", n, text, at)))
    row, col = zip(*out, strict=True)
    return np.concatenate(row), np.concatenate(col)


def forward_backward(e: np.ndarray, real: np.ndarray, t: np.ndarray, with_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals [chain, word, label] and, where asked for, summed pair marginals [label, label] from emission scores e,
    for words where real holds (each chain's real words come first), and transition scores t."""
    n, m, k = e.shape
    x, step = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(t)
    a, b = np.empty_like(x), np.ones_like(x)
    a[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, m):
        v = (a[:, i - 1] @ step) * x[:, i]
        v /= v.sum(axis=1, keepdims=True)
        a[:, i] = np.where(real[:, i, None], v, a[:, i - 1])
    for i in range(m - 2, -1, -1):
        v = (x[:, i + 1] * b[:, i + 1]) @ step.T
        v /= v.sum(axis=1, keepdims=True)
        b[:, i] = np.where(real[:, i + 1, None], v, 1.0)
    p = a * b
    p /= p.sum(axis=2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, m) if with_pairs else ():
        left, right = a[:, i - 1], x[:, i] * b[:, i]
        z = np.einsum("ni,ij,nj->n", left, step, right)
        w = np.where(real[:, i], 1 / np.maximum(z, 1e-300), 0.0)
        pairs += step * np.einsum("ni,nj->ij", left * w[:, None], right)
    return p, pairs


@dataclass(frozen=True)
class Crf:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def emissions(row: np.ndarray, col: np.ndarray, words: int, weights: np.ndarray) -> np.ndarray:
    """Each word's score for each label: the mean weight of its features, times the root of their number."""
    n = np.bincount(row, minlength=words)
    out = np.stack([np.bincount(row, weights[col, j], minlength=words) for j in range(weights.shape[1])], axis=1)
    return out / np.sqrt(np.maximum(n, 1))[:, None]


def train(samples: list[tuple[str, str]], seed: int = 7) -> Crf:
    """A CRF from (text, language): Adagrad on the likelihood of all chains, STEPS times."""
    languages = sorted({lang for _, lang in samples})
    rng, k = np.random.default_rng(seed), len(languages)
    runs: dict[str, list[list[str]]] = {lang: [] for lang in languages}
    for text, lang in samples:
        own = text.split()
        if lang in runs and own:
            a = int(rng.integers(0, max(1, len(own) - TRAIN_WORDS + 1)))
            runs[lang].append(own[a : a + TRAIN_WORDS])
    chains = [(r, [i] * len(r)) for i, lang in enumerate(languages) for r in runs[lang]]
    for i in rng.permutation(len(chains))[: len(chains) // 2]:
        (r, y), (r2, y2) = chains[i], chains[int(rng.integers(0, len(chains)))]
        cut = int(rng.integers(0, len(r) + 1))
        chains.append((r[:cut] + r2[cut:], y[:cut] + y2[cut:]))
    words = sorted({w for r, _ in chains for w in r})
    at = {w: i for i, w in enumerate(words)}
    row, col = word_features(words)
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(words)), 1))
    ids, gold = np.full((len(chains), TRAIN_WORDS), -1), np.zeros((len(chains), TRAIN_WORDS), dtype=np.int64)
    for i, (r, y) in enumerate(chains):
        ids[i, : len(r)], gold[i, : len(r)] = [at[w] for w in r], y[: len(r)]
    real = ids >= 0
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1.0)
    block = max(1, CELLS // max(1, k))  # chains at a time: what they take does not grow with the languages
    w, t, gw, gt = np.zeros((DIMENSIONS, k)), np.zeros((k, k)), np.full((DIMENSIONS, k), 1e-6), np.full((k, k), 1e-6)
    for _ in range(STEPS):
        e = np.stack([np.bincount(row, w[col, j], minlength=len(words)) for j in range(k)], axis=1) * scale[:, None]
        by_word, pairs = np.zeros((len(words), k)), np.zeros((k, k))
        for i in range(0, len(chains), block):
            use, at_word, label = real[i : i + block], ids[i : i + block], gold[i : i + block]
            p, found = forward_backward(np.where(use[..., None], e[at_word], 0.0), use, t, with_pairs=True)
            diff = (np.eye(k)[label] - p) * use[..., None]
            by_word += np.stack([np.bincount(at_word[use], diff[..., j][use], minlength=len(words)) for j in range(k)], axis=1)
            pairs += found
        by_word *= scale[:, None]
        grad = np.stack([np.bincount(col, by_word[row, j], minlength=DIMENSIONS) for j in range(k)], axis=1) - 1e-3 * w
        gw += grad**2
        w += 0.5 * grad / np.sqrt(gw)
        grad = (seen - pairs) - 1e-3 * t
        gt += grad**2
        t += 0.2 * grad / np.sqrt(gt)
    return Crf(languages, w, t)


def fit(docs: DataFrame, train_rows: Column, sample: int = SAMPLE) -> Crf:
    """Learns from at most `sample` documents of each language among those where train_rows holds."""
    from pyspark.sql import Window

    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & train_rows).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(1, min(sample, sample * LANGUAGES // max(1, len(counts))))
    # of each language the ids with a hash below a bound that lets some 2 * each pass; so few meet in a task
    bound = docs.sparkSession.createDataFrame([(lang, int(min(1.0, 2 * each / n + 64 / n) * (1 << 31))) for lang, n in counts.items()], "lang string, bound long")
    h = F.xxhash64("doc_id")
    offered = known.join(F.broadcast(bound), "lang").where(h.bitwiseAND(F.lit((1 << 31) - 1)) < F.col("bound")).withColumn("h", h.bitwiseAND(F.lit((1 << 31) - 1)))
    r = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = written(offered.withColumn("r", r).where(F.col("r") <= each).select("doc_id", "lang"), "language-sample")
    rows = texts(docs).join(F.broadcast(picked), "doc_id").where("length(text) > 0")
    pick = F.slice(F.split(F.trim("text"), r"\s+"), F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.size(F.split(F.trim("text"), r"\s+")) - 2 * TRAIN_WORDS)).cast("int"), 2 * TRAIN_WORDS)
    found = rows.select(F.array_join(pick, " ").alias("t"), "lang", "doc_id").orderBy("doc_id", "lang", "t").collect()
    return train([(r.t, r.lang) for r in found]) if found else Crf([], np.zeros((DIMENSIONS, 0)), np.zeros((0, 0)))


class Labeller:
    """predict(texts): language, score and number of switches of each text."""

    def __init__(self, model: Crf):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, dtype=bool)

    def _ids(self, split: list[list[str]]) -> np.ndarray:
        met = set().union(*split)
        new = list(met - self.known.keys())
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                self.table, self.letters = self.table[:0], self.letters[:0]
                new = list(met)
            row, col = word_features(new)
            letters = np.zeros(len(new), dtype=bool)
            letters[row] = True
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, emissions(row, col, len(new), self.model.weights)])
            self.letters = np.concatenate([self.letters, letters])
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))

    def marginals(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """[word, label] of the words of texts with so many words each."""
        chains = -(-count // CHAIN)
        first = np.cumsum(chains) - chains
        begin = np.cumsum(count) - count
        text = np.repeat(np.arange(len(count)), count)
        place = np.arange(len(ids)) - begin[text]
        chain, at = first[text] + place // CHAIN, place % CHAIN
        out = np.empty((len(ids), len(self.model.languages)))
        size = max(1, min(4096, CELLS // max(1, out.shape[1])))
        order = np.searchsorted(chain, np.arange(0, int(chains.sum()) + size, size))
        for a, b in zip(order[:-1], order[1:], strict=True):  # at most 4096 chains at a time
            if a == b:
                continue
            c, n = chain[a:b] - chain[a], int(chain[b - 1] - chain[a]) + 1
            e, real = np.zeros((n, CHAIN, out.shape[1])), np.zeros((n, CHAIN), dtype=bool)
            e[c, at[a:b]], real[c, at[a:b]] = self.table[ids[a:b]], True
            p, _ = forward_backward(e, real, self.model.transitions)
            out[a:b] = p[c, at[a:b]]
        return out

    def predict(self, batch: list[str]) -> list[tuple[str, float, int]]:
        if not self.model.languages:
            return [("und", 0.0, 0)] * len(batch)
        split = [t.split() for t in batch]
        count = np.array([len(s) for s in split])
        ids = self._ids(split)
        p = self.marginals(ids, count)
        use = self.letters[ids]
        text = np.repeat(np.arange(len(batch)), count)
        total = np.stack([np.bincount(text, p[:, j] * use, minlength=len(batch)) for j in range(p.shape[1])], axis=1)
        n = np.bincount(text, use, minlength=len(batch))
        best = p.argmax(axis=1)
        same = (text[1:] == text[:-1]) & (best[1:] != best[:-1])
        switches = np.bincount(text[1:][same], minlength=len(batch)) if len(text) else np.zeros(len(batch))
        out = []
        for i in range(len(batch)):
            if n[i]:
                j = int(total[i].argmax())
                out.append((self.model.languages[j], float(min(1.0, total[i, j] / n[i])), int(switches[i])))
            else:
                out.append(("und", 0.0, 0))
        return out


def _predict(model: Crf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            for b in pieces(batch, "text"):
                r = labeller.predict(b.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "lang_pred": pa.array([x[0] for x in r], pa.string()), "score": pa.array([x[1] for x in r], pa.float64()), "n_switches": pa.array([x[2] for x in r], pa.int64())})

    return run


def identify(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score, n_switches of every text."""
    return texts(docs).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, n_switches long")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit(docs, ~fold(4, 2)))
    return out.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score", "n_switches")
