"""LM scoring by Katz backoff: Good-Turing discounted bigrams and unigrams with exactly normalised backoff weights.

Tokens are words (A-Z lower-cased) and an end for each text; the first token's context is a begin mark. Counts r <= CUT are
discounted by Good-Turing, d(r) = (r*/r - w) / (1 - w) with w = (CUT + 1) n(CUT + 1) / n(1); where the counts of counts
give no discount between 0 and 1, it is (r - 0.5) / r. The unigrams' lost mass goes to one unknown token. For a context
h, alpha(h) = (1 - sum of its bigrams' probabilities) / (1 - sum of their unigram probabilities), over all its bigrams, so
each distribution sums to 1; a context all of whose counts are above CUT gets one more in its denominator, so its lost mass
isn't 0. A token is evaluated recursively: its bigram if seen, else alpha times its unigram, else the unknown token.

Two tables, partitioned and stored in the shared folder, hold the counts: the unigrams, and the texts' bigrams by a hash of
the context. Every text is reduced to its distinct bigrams before any shuffle. Almost every bigram of a corpus is rare, so the
second table is the large one: the HEAD most frequent words go by their rank, and each task packs the bigrams of a bucket
into one binary value of byte planes, some 4 bytes for each. A word outside the head brings its own count with it, joined by
word (it is rare, so no such key is hot); the head's counts are sent to the tasks once, some 20 MB at most. A bucket has some
BUCKET bigrams; a context with more of them is spread over buckets by its next word, and the sums of its parts meet on the
driver, one row for each such context (they are words of the head). Values go back to their texts in the same way, packed
by blocks of texts, as whole multiples of 2**-32, so sums don't depend on their order.

Defined cases: a null or empty text is one end token; without any training token every token is unknown (probability 1);
repeated rows are scored (and counted) each; a null doc_id is kept and belongs to the training rows; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keyed, mix, pieces, words, written
from .toxicity import fold

CUT = 5
BEGIN, END = np.uint64(0x5EED_BE61), np.uint64(0x5EED_0E2D)
#: Words that go by rank; bigrams of a bucket, and of a context before it is spread; texts of a block; bigrams that a task packs at a time.
HEAD, BUCKET, BLOCK, FLUSH = 1 << 19, 1 << 18, 1 << 12, 1 << 19
#: Bits of a rank, and of a hash that find a word in the head.
RANK_BITS, FIND_BITS = 20, 21
#: The sign bit marks a word by its hash, not its rank.
FAR = np.int64(-(1 << 63))
UNIT = float(1 << 32)


# ---- packed columns of whole numbers -------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers, equally long, as byte planes: high planes are mostly zeros and take next to nothing."""
    planes = [c.astype("<i8").view(np.uint8).reshape(-1, 8).T for c in columns]
    return zstandard.compress(np.concatenate(planes).tobytes() if len(columns[0]) else b"", 1)


def unpack(blob: bytes, n: int) -> np.ndarray:
    """[column, row] of n packed columns."""
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(n, 8, -1)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).view("<i8")[..., 0]


def unpacked(blobs, n: int) -> np.ndarray:
    return np.concatenate([unpack(x.as_py(), n) for x in blobs], axis=1)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


# ---- discounts ----------------------------------------------------------------------------------


def discounts(n: dict[int, int], cut: int = CUT) -> list[float]:
    """d(1) ... d(cut) from the counts of counts."""
    w = (cut + 1) * n.get(cut + 1, 0) / n[1] if n.get(1) else 1.0
    out = []
    for r in range(1, cut + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (n[r] * r) - w) / (1 - w) if n.get(r) and w < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


def discounted(c: np.ndarray, d: list[float]) -> np.ndarray:
    """d(c) * c."""
    return np.where(c <= len(d), np.array([0.0, *d])[np.minimum(c, len(d))], 1.0) * c


class Unigrams:
    """The head of the vocabulary by rank, and what a count means: p(count), base(count) in log10."""

    def __init__(self, counts: DataFrame, head: int = HEAD, bucket: int = BUCKET):
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).head()
        self.n, self.v = int(total.n), int(total.v)
        of = {r.c: r.n for r in counts.where(F.col("c") <= CUT + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.d = discounts(of)
        by_count = F.element_at(F.array(*map(F.lit, self.d)), F.least("c", F.lit(CUT)).cast("int"))
        kept = counts.agg(F.coalesce(F.sum(F.when(F.col("c") <= CUT, by_count * F.col("c")).otherwise(F.col("c"))), F.lit(0.0))).head()[0]
        seen = float(kept) / max(self.n, 1)
        self.unknown = 1 - seen if seen < 1 - 1e-12 else 1 / (self.n + 1)
        self.scale = (1 - self.unknown) / seen if seen else 1.0
        top = counts.orderBy(F.desc("c"), "tok").limit(head).toArrow()
        tok, c = (top.column(x).to_numpy().astype(np.int64) for x in ("tok", "c"))
        tok = tok.view(np.uint64)
        order = np.argsort(tok)
        self.sorted, self.rank, self.count = tok[order], order.astype(np.int32), c
        self.start = np.searchsorted(self.sorted >> np.uint64(64 - FIND_BITS), np.arange((1 << FIND_BITS) + 1, dtype=np.uint64)).astype(np.int32)
        self.share = np.maximum(1, c // bucket)  # over how many buckets a context of the head is spread

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / max(self.n, 1) * self.scale, self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.n + self.v + 1))

    def ids(self, tok: np.ndarray) -> np.ndarray:
        """Ranks of the words of the head, hashes with the sign bit of others."""
        out = tok.view(np.int64) | FAR
        beginning = (tok >> np.uint64(64 - FIND_BITS)).astype(np.int64)
        at, stop = self.start[beginning], self.start[beginning + 1]
        left = np.flatnonzero(at < stop)
        while len(left):
            a = at[left]
            hit = self.sorted[a] == tok[left]
            out[left[hit]] = self.rank[a[hit]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return out


# ---- passes over the texts ----------------------------------------------------------------------


def _tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, token) of each token of a batch."""
    h, bounds = words(b.column("text"))
    count = np.diff(bounds) + 1
    last = np.cumsum(count) - 1
    tok = np.empty(int(count.sum()), np.uint64)
    is_end = np.zeros(len(tok), bool)
    is_end[last] = True
    tok[is_end], tok[~is_end] = END, h
    ctx = np.concatenate([[BEGIN], tok[:-1]])
    ctx[(last + 1)[:-1]] = BEGIN
    return np.repeat(np.arange(b.num_rows), count), ctx, tok


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the training texts and their counts, combined over many texts."""

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        tok, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(tok, kind="stable")
        at = runs(tok[order])
        return tok[order][at], np.add.reduceat(c[order], at) if len(at) else c

    own, n = [], 0
    for b in (p for batch in batches for p in pieces(batch, "text", 2 << 20)):
        text, _, tok = _tokens(b)
        own.append(np.unique(tok[~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[text]], return_counts=True))
        n += len(own[-1][0])
        if n >= FLUSH:
            own = [summed(own)]
            n = len(own[0][0])
            if n >= FLUSH // 2:
                yield pa.RecordBatch.from_pydict({"tok": pa.array(own[0][0].view(np.int64)), "c": pa.array(own[0][1])})
                own, n = [], 0
    if own:
        tok, c = summed(own)
        yield pa.RecordBatch.from_pydict({"tok": pa.array(tok.view(np.int64)), "c": pa.array(c)})


def _stats(head: Broadcast):
    """Of each text its tokens, those known and their base score, as far as they are words of the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = head.value
        value = np.append(np.rint(u.base(u.count) * UNIT), 0.0)  # the others' counts come by their join
        for b in (p for batch in batches for p in pieces(batch, "text", 2 << 20)):
            text, _, tok = _tokens(b)
            ids = u.ids(tok)
            sums = [np.bincount(text, x, b.num_rows) for x in (None, ids >= 0, value[np.maximum(ids, -1)])]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "key": b.column("key"), "held_out": b.column("held_out"), **{n: pa.array(x.astype(np.int64)) for n, x in zip(("n_tokens", "n_known", "base"), sums, strict=True)}})

    return run


def _entries(b: pa.RecordBatch, u: Unigrams, rare: bool) -> list[np.ndarray]:
    """(context, token, key, 2 n + held out) of each text's distinct bigrams whose token is in the head, or is rare."""
    text, _, tok = _tokens(b)
    ids = u.ids(tok)
    ctx = np.append(u.ids(np.array([BEGIN]))[0], ids[:-1])
    ctx[runs(text)] = u.ids(np.array([BEGIN]))[0]
    use = (ids < 0) == rare
    text, ctx, ids = text[use], ctx[use], ids[use]
    near = (ctx >= 0) & (ids >= 0) & (text < 1 << (63 - 2 * RANK_BITS))  # these three make one number
    number, count = np.unique((text[near] << (2 * RANK_BITS)) | (ctx[near] << RANK_BITS) | ids[near], return_counts=True)
    far = [x[~near] for x in (text, ctx, ids)]
    order = np.lexsort(far[::-1])
    far = [x[order] for x in far]
    at = runs(*far)
    mask = (1 << RANK_BITS) - 1
    text, ctx, ids = (np.concatenate([x, y[at]]) for x, y in zip((number >> (2 * RANK_BITS), number >> RANK_BITS & mask, number & mask), far, strict=True))
    n = np.concatenate([count, np.diff(np.append(at, len(order)))])
    keys, held = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "held_out"))
    return [ctx, ids, keys[text], 2 * n + held[text]]


def _rare(head: Broadcast):
    """The bigrams whose token is outside the head, as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for batch in batches for p in pieces(batch, "text", 2 << 20)):
            yield pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in zip(("h", "w", "key", "n"), _entries(b, head.value, True), strict=True)})

    return run


def by_pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A number for each bigram; those of a context follow each other. For as many rare words as a few million bigrams may hold."""

    def near(x: np.ndarray) -> np.ndarray:
        rare = x < 0
        if not rare.any():
            return x
        out = x.copy()
        out[rare] = (1 << RANK_BITS) + np.unique(x[rare], return_inverse=True)[1]
        return out

    return near(h) << 32 | near(w)


def _packer(u: Unigrams, buckets: int):
    """Packs (h, w, key, n, c) of some bigrams by bucket."""
    share = u.share

    def packed(e: list[np.ndarray]) -> pa.RecordBatch:
        h, w = e[0], e[1]
        parts = np.where(h >= 0, share[np.maximum(h, 0)], 1) if len(share) else np.ones(len(h), np.int64)
        salt = mix(w.astype(np.uint64) + np.uint64(7)) % parts.astype(np.uint64)
        bucket = (mix(h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((by_pair(h, w), bucket))
        bucket, e = bucket[order], [x[order] for x in e]
        at = runs(bucket)
        blobs = []
        for a, z in zip(at, np.append(at[1:], len(bucket)), strict=True):
            own = [x[a:z] for x in e]
            own[0] = np.diff(own[0], prepend=np.int64(0))
            blobs.append(pack(*own))
        return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return packed


def _flushed(parts: Iterator[list[np.ndarray]], packed) -> Iterator[pa.RecordBatch]:
    own, n = [], 0
    for e in parts:
        own.append(e)
        n += len(e[0])
        if n >= FLUSH:
            yield packed([np.concatenate(x) for x in zip(*own, strict=True)])
            own, n = [], 0
    if n:
        yield packed([np.concatenate(x) for x in zip(*own, strict=True)])


def _common(head: Broadcast, buckets: int):
    """The bigrams whose token is in the head, packed without its count: whoever reads the rank has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = head.value
        found = (_entries(b, u, False) for batch in batches for b in pieces(batch, "text", 2 << 20))
        yield from _flushed(([*e, np.zeros(len(e[0]), np.int64)] for e in found), _packer(u, buckets))

    return run


def _repack(head: Broadcast, buckets: int):
    """Rows of _rare with their tokens' counts, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flushed(([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h", "w", "key", "n", "c")] for b in batches if b.num_rows), _packer(head.value, buckets))

    return run


# ---- passes over the buckets --------------------------------------------------------------------


def _bucket(blobs, head: np.ndarray) -> tuple:
    """A bucket's bigrams in order: their columns, where each distinct one begins, its training count; where each context begins."""
    parts = [unpack(x.as_py(), 5) for x in blobs]
    h, w, key, n, c = np.concatenate([np.concatenate([np.cumsum(x[:1], axis=1), x[1:]]) for x in parts], axis=1)
    near = w >= 0
    c[near] = head[w[near]]
    pair = by_pair(h, w)
    order = np.argsort(pair)
    h, key, n, c = (x[order] for x in (h, key, n, c))
    at = runs(pair[order])
    return h, key, n >> 1, c, at, np.add.reduceat((n >> 1) * (1 - (n & 1)), at), runs(h[at])


def _sums(head: Broadcast):
    """Of each bucket the counts of counts (h null), and of each spread context its count, counts of counts and unigram mass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = head.value
        spread = u.share > 1
        for batch in batches:
            ids, rows = [], []
            for blobs in batch.column("blobs"):
                h, _, _, c1, at, c, new = _bucket(blobs, u.count)
                r = np.stack([c == i for i in range(1, CUT + 2)], axis=1).astype(np.int64)
                ids.append(None)
                rows.append([*r.sum(axis=0), 0, 0.0])
                if spread.any():
                    per = [np.add.reduceat(x, new) for x in (*r.T[:CUT], np.where(c > CUT, c, 0), c, np.where(c > 0, u.p(c1[at]), 0.0))]
                    for i in np.flatnonzero((h[at][new] >= 0) & spread[np.maximum(h[at][new], 0)]):
                        ids.append(int(h[at][new][i]))
                        rows.append([x[i] for x in per])
            yield pa.RecordBatch.from_pydict({"h": pa.array(ids, pa.int64()), **{f"s{j}": pa.array([float(x[j]) for x in rows], pa.float64()) for j in range(CUT + 3)}})

    return run


def context_weights(d: list[float], c_by: np.ndarray, more: np.ndarray, total: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, alpha) of contexts from their counts of counts, the sum of larger counts, the whole count, the unigram mass."""
    kept = c_by @ (np.array(d) * np.arange(1, CUT + 1)) + more
    below = np.where(kept < total - 1e-9, total, total + 1)
    return below, np.where(total > 0, (1 - kept / below) / np.maximum(1 - q, 1e-15), 1.0)


def _values(head: Broadcast, d: list[float], spread: tuple[np.ndarray, np.ndarray, np.ndarray], blocks: int):
    """Each bucket's part of the texts' scores, packed by block of texts. spread: contexts in many buckets, their denominators and alphas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = head.value
        for batch in batches:
            for blobs in batch.column("blobs"):
                h, key, n, c1, at, c, new = _bucket(blobs, u.count)
                p, own = u.p(c1[at]), h[at][new]
                by = np.stack([np.add.reduceat((c == i).astype(np.int64), new) for i in range(1, CUT + 1)], axis=1)
                below, alpha = context_weights(d, by, np.add.reduceat(np.where(c > CUT, c, 0), new), np.add.reduceat(c, new), np.add.reduceat(np.where(c > 0, p, 0.0), new))
                if len(spread[0]):
                    i = np.minimum(np.searchsorted(spread[0], own), len(spread[0]) - 1)
                    hit = spread[0][i] == own
                    below, alpha = np.where(hit, spread[1][i], below), np.where(hit, spread[2][i], alpha)
                context = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(at))))
                lp = np.where(c > 0, np.log10(np.maximum(discounted(c, d), 1e-300) / below[context]), np.log10(np.maximum(alpha[context], 1e-300)) + np.log10(p))
                value = n * np.rint(np.repeat(lp, np.diff(np.append(at, len(h)))) * UNIT).astype(np.int64)
                order = np.argsort(key)
                text = runs(key[order])
                key, value = key[order][text], np.add.reduceat(value[order], text)
                block = (mix(key.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                block, key, value = block[order], key[order], value[order]
                first = runs(block)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(block[first], pa.int64()),
                    "blob": pa.array([pack(np.diff(key[a:z], prepend=np.int64(0)), value[a:z]) for a, z in zip(first, np.append(first[1:], len(block)), strict=True)], pa.binary()),
                })

    return run


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blobs in batch.column("blobs"):
            parts = [unpack(x.as_py(), 2) for x in blobs]
            key, value = np.concatenate([np.cumsum(x[0]) for x in parts]), np.concatenate([x[1] for x in parts])
            order = np.argsort(key, kind="stable")
            at = runs(key[order])
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[order][at]), "score": pa.array(np.add.reduceat(value[order], at))})


def score(docs: DataFrame, held_out: Column, head: int = HEAD, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; learns where held_out is false."""
    rows, _ = keyed(docs)
    source = rows.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    counts = written(source.mapInArrow(_counts, "tok long, c long").groupBy("tok").agg(F.sum("c").alias("c")), "katz-unigrams")
    u = Unigrams(counts, head, bucket)
    sent = docs.sparkSession.sparkContext.broadcast(u)  # of HEAD words at most
    stats = written(source.mapInArrow(_stats(sent), "doc_id long, key long, held_out boolean, n_tokens long, n_known long, base long"), "katz-texts")
    of = stats.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).head()
    buckets, blocks = max(1, -(-of[1] // bucket)), max(1, -(-of[0] // BLOCK))

    # bigrams with a rare token get its count; all go to their buckets
    rare = source.mapInArrow(_rare(sent), "h long, w long, key long, n long")
    rare = written(rare.join(counts.select(F.col("tok").bitwiseOR(F.lit(int(FAR))).alias("w"), "c"), "w", "left").select("h", "w", "key", "n", F.coalesce("c", F.lit(0)).cast("long").alias("c")), "katz-rare")
    packed = source.mapInArrow(_common(sent, buckets), "bucket long, blob binary").unionByName(rare.mapInArrow(_repack(sent, buckets), "bucket long, blob binary"))
    bigrams = written(packed.groupBy("bucket").agg(F.collect_list("blob").alias("blobs")), "katz-bigrams")

    sums = bigrams.select("blobs").mapInArrow(_sums(sent), "h long, " + ", ".join(f"s{j} double" for j in range(CUT + 3)))
    sums = sums.groupBy("h").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(CUT + 3))).toPandas()
    of_bigrams, apart = sums[sums["h"].isna()], sums[sums["h"].notna()].sort_values("h")
    d = discounts({r: int(of_bigrams[f"s{r - 1}"].sum()) for r in range(1, CUT + 2)})
    s = apart[[f"s{j}" for j in range(CUT + 3)]].to_numpy(float)
    spread = (apart["h"].to_numpy(np.int64), *context_weights(d, s[:, :CUT], s[:, CUT], s[:, CUT + 1], s[:, CUT + 2]))

    values = bigrams.select("blobs").mapInArrow(_values(sent, d, spread, blocks), "block long, blob binary")
    scores = written(values.groupBy("block").agg(F.collect_list("blob").alias("blobs")).select("blobs").mapInArrow(_scores, "key long, score long"), "katz-scores")
    sent.destroy()
    discard(bigrams)

    n, known = F.shiftright("n", 1), F.col("c") > 0
    base = F.round(F.log10((F.col("c") + 1) / F.lit(float(u.n + u.v + 1))) * UNIT).cast("long")
    others = rare.groupBy("key").agg(F.sum(n * base).alias("more"), F.sum(F.when(known, n).otherwise(0)).alias("known"))
    out = stats.join(scores, "key").join(others, "key", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(u.n).cast("long").alias("train_tokens"),
        ((F.col("base") + F.coalesce("more", F.lit(0))) / UNIT).alias("base_score"), (F.col("score") / UNIT).alias("score"),
    )


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(7, 2))
