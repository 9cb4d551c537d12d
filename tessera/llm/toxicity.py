"""Toxicity: a lexicon learned from labels, a trie of it intersected with Levenshtein automata, and context windows.

Lexicon. Words and stems (beginnings of words) that labelled toxic training texts hold far more often than clean ones, by
a test of significance over all words, stems included. What counts is in how many different surroundings (words before and
after) a term is found, so the words of a text that was copied many times are no evidence. The texts are a bounded sample:
at most SAMPLE of each label, those with the smallest hash of doc_id.

Automaton. The trie of the lexicon is intersected with Levenshtein automata of the terms' own distances: 1 from four letters
(stems: six), 2 from nine, anywhere in the word, but none for a term whose misspellings clean texts of the sample hold. A state is a set of (trie node, errors); states are made when first met,
so a word is followed letter by letter and most are dead after two or three.

Context. A hit inside quotation marks, or beside a word of reporting, is a quotation. A text's weight of hits is the number
of its terms, with misspelled ones at MISSPELLED and quoted ones at QUOTED of a term; the score is a logistic regression on it
and on its share of the words, whose weights are never negative, so a hit never lowers a score.

Defined cases: a null or empty text, or one without hits, has the score of no hits; without labelled rows of both kinds
there is no lexicon and every score is 0; repeated rows give their own rows; a null doc_id is kept and is no training
row; null labels are no labels; a doc_id with several labels counts as toxic if one of them is; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, release, texts, without, written

#: Bound of the training sample for each label, and of the words a task remembers.
SAMPLE, CACHE = 10_000, 150_000
#: A term is in at least LEAST surroundings in toxic texts, RATIO times as often as in clean ones, and chance makes none of that
#: significance in DOUBT of all lexicons.
LEAST, RATIO, DOUBT = 6, 20.0, 0.01
#: What a misspelled and a quoted hit count.
MISSPELLED, QUOTED = 0.8, 0.25
STEM, STEM_MOST = 4, 6
STRIP = ".,;:!?()[]{}<>|*&%$#@~_-=+/\\'\"`«»“”„‘’¡¿…"
MARKS = "\"“”„«»"
REPORTING = frozenset(("said", "says", "wrote", "called", "quoted", "quote", "dijo", "llamó", "sagte", "nannte", "dit", "appelé"))
WINDOW = 3


def _own_terms(word: str) -> list[str]:
    """A word and its stems; a stem begins with ^."""
    return [word, *(f"^{word[:k]}" for k in range(STEM, STEM_MOST + 1) if len(word) > k)] if word else []


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic texts with it, clean texts with it) of each batch."""
    release()
    for b in (p for batch in batches for p in pieces(batch, "text")):
        counts = (Counter(), Counter())
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            counts[toxic].update({t for w in {w.strip(STRIP) for w in text.lower().split()} for t in _own_terms(w)})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "toxic": pa.array([counts[1][t] for t in terms], pa.int64()), "clean": pa.array([counts[0][t] for t in terms], pa.int64())})


def _surroundings(candidates: set[str]):
    """(term, near, toxic) of the candidates: near stands for the words before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in pieces(batch, "text")):
            found = set()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = ["", *text.lower().split(), ""]
                for i in range(1, len(own) - 1):
                    found.update((t, zlib.crc32(f"{own[i - 1]} {own[i + 1]}".encode()), toxic) for t in _own_terms(own[i].strip(STRIP)) if t in candidates)
            rows = list(found)
            yield pa.RecordBatch.from_pydict({"term": pa.array([r[0] for r in rows], pa.string()), "near": pa.array([r[1] for r in rows], pa.int64()), "toxic": pa.array([r[2] for r in rows], pa.int32())})

    return run


def significance(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Log-likelihood ratio of a term's toxic and clean counts against the shares of the sample."""
    share = n_toxic / (n_toxic + n_clean)
    part = lambda c, p: F.when(c > 0, c * F.log(c / ((toxic + clean) * p))).otherwise(0.0)
    return part(toxic, share) + part(clean, 1 - share)


def choose_terms(found: list[tuple[str, int, int]]) -> list[str]:
    """Words and stems from (term, toxic, clean): a word stands for its stem where it makes up most of it."""
    count = {t: a for t, a, _ in found}
    words = {t: a for t, a in count.items() if t[0] != "^"}
    out: set[str] = set()
    covered: set[str] = set()
    for stem, a in sorted(((t, a) for t, a in count.items() if t[0] == "^" and len(t) == STEM + 1), key=lambda x: (-x[1], x[0])):
        own = {w: n for w, n in words.items() if w.startswith(stem[1:])}
        covered |= set(own)
        if own and max(own.values()) >= 0.7 * a:
            out |= {w for w, n in own.items() if n >= 0.1 * a}
        else:
            out |= set(own)  # beside the stem, so that their misspellings match
            longer = [t for t in count if t[0] == "^" and t.startswith(stem) and count[t] >= 0.95 * a]
            out.add(max(longer, key=len))
    out |= set(words) - covered
    return sorted(out, key=lambda t: (-count[t], t))


class Automaton:
    """match(word): 0 no term, 1 a term, 2 a misspelled term."""

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[dict] = [{}]
        self.most = [0]
        for term in terms:
            stem, word = term[0] == "^", term.lstrip("^")
            allowed = 0 if term in strict or len(word) < (6 if stem else 4) else 1 if stem or len(word) < 9 else 2
            node = 0
            self.most[0] = max(self.most[0], allowed)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append({})
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], allowed)
            self.ends[node]["stem" if stem else "word"] = allowed
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[int] = []
        self.dead = self._state(frozenset())
        self.start = self._state(self._close({(0, 0)}))

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.moves.append({})
            best = 0 if ("stem", 0) in s else min((e for v, e in s if v != "stem" and e <= self.ends[v].get("word", -1)), default=1 if ("stem", 1) in s else None)
            self.accepts.append(0 if best is None else 1 if best == 0 else 2)
        return self.states[s]

    def _close(self, s: set) -> frozenset:
        todo = list(s)
        while todo:  # letters of the term that the text lacks
            v, e = todo.pop()
            for u in self.children[v].values():
                if e + 1 <= self.most[u] and (u, e + 1) not in s:
                    s.add((u, e + 1))
                    todo.append((u, e + 1))
        return frozenset(s)

    def step(self, state: int, c: str) -> int:
        known = self.moves[state].get(c)
        if known is None:
            now = self.sets[state]
            if ("stem", 0) in now:
                known = state
            else:
                new: set = set()
                for v, e in now:
                    if v == "stem":
                        continue
                    u = self.children[v].get(c)
                    if u is not None:
                        new.add((u, e))
                    if e + 1 <= self.most[v]:
                        new.add((v, e + 1))
                        new |= {(w, e + 1) for w in self.children[v].values() if e + 1 <= self.most[w]}
                closed = self._close(new)
                stems = [e for v, e in closed if e <= self.ends[v].get("stem", -1)]
                if 0 in stems:
                    closed = frozenset({("stem", 0)})
                elif stems or ("stem", 1) in now:
                    closed |= {("stem", 1)}
                known = self._state(closed)
            self.moves[state][c] = known
        return known

    def match(self, word: str) -> int:
        state, dead = self.start, self.dead
        for c in word:
            state = self.step(state, c)
            if state == dead:
                return 0
        return self.accepts[state]


class Scanner:
    """hits(text): how many terms, misspelled terms and quoted terms a text holds, and its words."""

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()):
        self.automaton = Automaton(terms, strict)
        self.known: dict[str, int] = {}

    def code(self, word: str) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = code = self.automaton.match(word.lower().strip(STRIP))
        return code

    def hits(self, text: str) -> tuple[int, int, int, int]:
        split = text.split()
        get, code = self.known.get, self.code
        codes = [c if (c := get(w)) is not None else code(w) for w in split]
        if not any(codes):
            return 0, 0, 0, len(split)
        exact = fuzzy = quoted = 0
        opened, inside = 0, []
        for w in split:  # inside[i]: whether a quotation is open at word i
            before = sum(w.count(m) for m in MARKS)
            inside.append(opened % 2 == 1 or before > 0)
            opened += before
        for i, c in enumerate(codes):
            if c:
                near = split[max(0, i - WINDOW) : i + WINDOW + 1]
                if (inside[i] and opened > 1) or any(w.lower().strip(STRIP) in REPORTING for w in near):
                    quoted += 1
                elif c == 1:
                    exact += 1
                else:
                    fuzzy += 1
        return exact, fuzzy, quoted, len(split)


def features(hits: np.ndarray) -> np.ndarray:
    exact, fuzzy, quoted, n = hits.astype(float).T
    weight = exact + MISSPELLED * fuzzy + QUOTED * quoted
    return np.column_stack([np.ones(len(hits)), np.log1p(weight), weight >= MISSPELLED, weight / np.maximum(n, 1) * 10])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge; all but the first are 0 or more: features with a negative one are left out."""
    use = list(range(x.shape[1]))
    while True:
        w, z = np.zeros(len(use)), x[:, use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
        worst = int(np.argmin(w[1:])) + 1 if len(w) > 1 else 0
        if not worst or w[worst] >= 0:
            out = np.zeros(x.shape[1])
            out[use] = w
            return out
        del use[worst]


@dataclass(frozen=True)
class Model:
    terms: list[str]
    weights: np.ndarray
    strict: frozenset[str] = frozenset()

    def scores(self, hits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(hits) @ self.weights, -30, 30)))


def _misspelled(terms: list[str]):
    """The words that match a term with errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Automaton(terms).match
        for b in (p for batch in batches for p in pieces(batch, "text")):
            words = {w.lower().strip(STRIP) for t in b.column("text").to_pylist() for w in set(t.split())}
            yield pa.RecordBatch.from_pydict({"word": pa.array([w for w in words if match(w) == 2], pa.string())})

    return run


def _hits(terms: list[str], strict: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(terms, strict)
        for b in (p for batch in batches for p in pieces(batch, "text")):
            h = np.array([scanner.hits(t) for t in b.column("text").to_pylist()], dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_pydict({"toxic": b.column("toxic"), **{c: pa.array(h[:, i]) for i, c in enumerate(("exact", "fuzzy", "quoted", "n"))}})

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Model:
    """Learns lexicon and weights from at most `sample` labelled rows of each label among those where train holds."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & train).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    picked = written(picked[0].unionByName(picked[1]), "toxicity-sample")  # at most 2 * sample rows: small enough to broadcast
    rows = written(texts(docs).join(F.broadcast(picked), "doc_id").select("text", "toxic"), "toxicity-texts")
    n = dict(rows.groupBy("toxic").count().collect())
    if not (n.get(0) and n.get(1)):
        return Model([], np.array([-30.0, 0, 0, 0]))
    counts = rows.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts, "toxicity-terms")
    bound = math.log(max(1, counts.where(F.col("toxic") + F.col("clean") >= LEAST).count()) / DOUBT)
    ratio = (F.col("toxic") + 0.5) / (n[1] + 1) >= RATIO * (F.col("clean") + 0.5) / (n[0] + 1)
    often = (F.col("toxic") >= LEAST) & ratio & (significance(F.col("toxic"), F.col("clean"), n[1], n[0]) >= bound)
    candidates = {r.term for r in counts.where(often).select("term").collect()}  # of a bounded sample
    near = rows.mapInArrow(_surroundings(candidates), "term string, near long, toxic int").distinct()
    near = near.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    terms = choose_terms([tuple(r) for r in near.where(often).collect()])
    clean = [r.word for r in rows.where("toxic = 0").mapInArrow(_misspelled(terms), "word string").distinct().collect()]  # of a bounded sample
    strict = frozenset(t for t in terms if any(map(Automaton([t]).match, clean)))
    h = rows.mapInArrow(_hits(terms, strict), "toxic int, exact long, fuzzy long, quoted long, n long").toPandas()
    x, y = features(h[["exact", "fuzzy", "quoted", "n"]].to_numpy()), h["toxic"].to_numpy(float)
    return Model(terms, logistic(x, y), strict)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scanner = Scanner(model.terms, model.strict)
        for b in (p for batch in batches for p in pieces(batch, "text")):
            h = np.array([scanner.hits(t) for t in b.column("text").to_pylist()], dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(model.scores(h)), "n_exact": pa.array(h[:, 0]), "n_fuzzy": pa.array(h[:, 1]), "n_quoted": pa.array(h[:, 2])})

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_exact, n_fuzzy, n_quoted of every text."""
    return texts(docs).mapInArrow(_score(model), "doc_id long, score double, n_exact long, n_fuzzy long, n_quoted long")


def fold(modulus: int, remainder: int) -> Column:
    """Whether crc32 of doc_id as text has that remainder; a null doc_id has none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, train: Column, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, with their columns as they are."""
    model = fit(docs, labels, train)
    bad = written(score_toxicity(docs, model).where((F.col("score") >= threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "toxic")
    return without(docs, bad, "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, ~fold(5, 0))
    return score_toxicity(docs, model).select("doc_id", fold(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_exact", "n_fuzzy", "n_quoted")
