"""N-gram Jaccard join in the metric space of shingle sets: pivots, Voronoi regions, windows, recursion - exact.

d(A, B) = 1 - |A & B| / |A | B| is a metric on finite sets, and any set may be a pivot. Unrelated documents all lie at
distance 1 from each other, so documents as first pivots would tell nothing apart; the first pivots here are the sets
{s} of one shingle, in a fixed order. A document's nearest pivots are its own shingles (d = 1 - 1/|A|, all others are at 1).

* Windows. Let X be the first i shingles of A in that order. If B holds none of them, d(B, X) = 1 and d(A, X) = 1 - i/|A|,
  so by the triangle inequality d(A, B) >= i/|A|. For i > (1 - t)|A| they cannot link. So A goes to the regions of its
  first floor((1 - t)|A|) + 1 pivots, and any two documents that link share a region.
* The order of pivots is free. Shingles that lie in many windows come last, the most frequent at the very end, as far as a
  list of bounded length holds them; this makes regions small and never changes the result. Windows that lose shingles to
  the end take in others, so these are counted too, in ORDER_ROUNDS rounds at most: of a frequent passage no shingle
  stays in a window that rarer shingles can fill.
* Regions join recursively. In each region documents become pivots: one at first, then WIDER times as many in each round,
  until all have been or the whole region is one component. Documents compare with a pivot of another component only:
  by size, by the windows that their places leave, by PARITY bits of each set, then exactly on the full sets. Documents that
  link to a pivot join its component at once, so a group of near copies costs a few comparisons a member, not all pairs.
* Windows again. A pair that links meets in the region of its first common shingle, too. There neither holds what the other
  has before it, so d(A, B) is at least what remains from that place on allows: a pair is compared only where both have as
  many shingles from the place on as linked sets have in common. This leaves out documents of a hot region that resemble each other
  in its frequent part but differ in rarer shingles before it, before a pair of them exists.

Documents with equal sets are one point of the space and are joined once.

Defined cases: a null or empty text and a text without words have n_shingles 0, link with nothing and are components of
their own; texts of one to k-1 words have one shingle, the whole sequence; each row is a document, also where doc_ids repeat
or rows are equal; a null doc_id names a component only where it has no other; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP, discard, keyed, mix, only, pieces, release, shingles, without, words, written

#: Shingles that lie in at least OFTEN windows come last in the order of pivots; at most ORDER_BOUND of them, the most frequent.
OFTEN, ORDER_BOUND = 16, 1 << 18
#: Rounds that count what the windows take in for each shingle that came last, and how many shingles ahead they look for it.
ORDER_ROUNDS, AHEAD = 1, 4
#: Growth of the number of pivots from round to round.
WIDER = 16
#: Rows of a region that one task compares with the region's pivots; the pivots go to each of the parts.
SPLIT = 1024
#: Bytes of text that a task hashes at a time.
PIECE = 2 << 20
#: Edges of a file of the tables that components are found in.
EDGES = 200_000
#: Regions that a join may broadcast, three longs each: some 8 MB on each executor. Above it the join shuffles.
BROADCAST_REGIONS = 100_000
#: Bits that bound how much two sets differ; those that the rows of a region hold, as longs, before a pair exists.
PARITY, ROW_BITS = 1024, 128
SIGNS = [f"w{i}" for i in range(ROW_BITS // 64)]


def shingle_sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer than k words has one, the whole sequence."""
    h, bounds = words(col)
    s, at = shingles(h, bounds, k)
    out = []
    for i in range(len(bounds) - 1):
        n = bounds[i + 1] - bounds[i]
        if n >= k:
            out.append(np.unique(s[at[i] : at[i + 1]]))
        elif n:
            own = h[bounds[i] : bounds[i + 1]]
            out.append(mix(np.array([(own * STEP[8 : 8 + n]).sum() + np.uint64(n)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def window_size(n, percent: int):
    """1 + the most shingles of n that two sets with that similarity can differ in."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def parity(x: np.ndarray, bits: int = PARITY) -> bytes:
    """Bit i is set where an odd number of shingle hashes fall on it. Two sets' bits differ in at most as many places as the
    sets differ in members."""
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _close(percent: int):
    """The pairs (a, b) whose bits allow the similarity: links have (100 + percent) * difference <= (100 - percent) * (na + nb)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, PARITY // 8) for c in ("xs", "ys"))
            apart = np.bitwise_count(xs ^ ys).sum(axis=1, dtype=np.int64)
            total = b.column("na").to_numpy() + b.column("nb").to_numpy()
            yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b")}).filter(pa.array((100 + percent) * apart <= (100 - percent) * total))

    return run


def _signatures(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                sets = shingle_sets(b.column("text"), k)
                n = np.array([len(x) for x in sets], dtype=np.int64)
                size = window_size(n, percent)
                heads = [x[:p] for x, p in zip(sets, size, strict=True)]
                flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
                signs = np.frombuffer(b"".join(parity(x, ROW_BITS) for x in sets), np.int64).reshape(len(sets), len(SIGNS))
                yield pa.RecordBatch.from_pydict({
                    **{w: pa.array(signs[:, i]) for i, w in enumerate(SIGNS)}, "doc_id": b.column("doc_id"), "n": pa.array(n), "bits": pa.array([parity(x) for x in sets], pa.binary()), "point": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                    "head": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat.view(np.int64))),
                })

    return run


def ordered(x: np.ndarray, late: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in the order of pivots: by hash, then those in `late` by rank; and where the late ones were."""
    if not len(late) or not len(x):
        return x, np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(late, x), len(late) - 1)
    is_late = late[at] == x
    if not is_late.any():
        return x, is_late
    return np.concatenate([x[~is_late], x[is_late][np.argsort(rank[at[is_late]], kind="stable")]]), is_late


def _taken_in(k: int, percent: int, late: np.ndarray, rank: np.ndarray):
    """The shingles that windows take in for those in `late`, AHEAD for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                found = [np.zeros(0, np.uint64)]
                for x in shingle_sets(b.column("text"), k):
                    p = int(window_size(len(x), percent))
                    by_pivot, is_late = ordered(x, late, rank)
                    lost = int(is_late[:p].sum())
                    if lost:
                        found.append(by_pivot[p - lost : min(p + (AHEAD - 1) * lost, len(x) - int(is_late.sum()))])
                yield pa.RecordBatch.from_pydict({"s": pa.array(np.concatenate(found).view(np.int64))})

    return run


def _windows(k: int, percent: int, late: np.ndarray, rank: np.ndarray):
    """Rows (pivot, doc_id, n, place) of each document's window, shingles in `late` last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for b in pieces(batch, "text", PIECE):
                sets = shingle_sets(b.column("text"), k)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                n = np.array([len(x) for x in sets], dtype=np.int64)
                size = window_size(n, percent)
                keys = [ordered(x, late, rank)[0][:p] for x, p in zip(sets, size, strict=True)]
                flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                begin = np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_pydict({
                    "pivot": pa.array(flat.view(np.int64)), "doc_id": pa.array(np.repeat(ids, size).astype(np.int64)), "n": pa.array(np.repeat(n, size)), "place": pa.array(np.arange(len(flat)) - begin),
                })

    return run


def _linked(k: int, percent: int):
    """The pairs (a, b) whose texts xs and ys link; a document's set is made once for the rows of a piece."""

    def sets_of(b: pa.RecordBatch, key: str, text: str) -> tuple[list[np.ndarray], np.ndarray]:
        _, at, back = np.unique(b.column(key).to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        return shingle_sets(b.column(text).take(pa.array(at)), k), back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "xs", PIECE):
                (xs, i), (ys, j) = sets_of(b, "a", "xs"), sets_of(b, "b", "ys")
                keep = []
                for x, y in zip((xs[v] for v in i), (ys[v] for v in j), strict=True):
                    if len(x) > len(y):
                        x, y = y, x
                    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_pydict({"a": b.column("a"), "b": b.column("b")}).filter(pa.array(keep, pa.bool_()))

    return run


def pivot_order(heads: DataFrame, source: DataFrame, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that come last, sorted, with their ranks; at most ORDER_BOUND of them. heads: the windows' shingles by hash alone."""
    found: dict[int, int] = {}
    late, rank = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for _ in range(1 + ORDER_ROUNDS):
        counted = heads.groupBy("s").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "s").limit(ORDER_BOUND).toPandas()
        new = {s: c for s, c in zip(counted["s"].tolist(), counted["count"].tolist(), strict=True) if c > found.get(s, 0)}
        if not new:
            break
        found |= new
        top = sorted(found.items(), key=lambda sc: (-sc[1], sc[0]))[:ORDER_BOUND]
        found = dict(top)
        keys = np.array([s for s, _ in reversed(top)], np.int64).view(np.uint64)  # rarest first
        rank = np.argsort(keys, kind="stable")
        late = keys[rank]
        heads = source.mapInArrow(_taken_in(k, percent, late, rank), "s long")
    return late, rank


def smallest_labels(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of the edges (a, b) reaches: labels spread to neighbours, then jump. Tables have a
    file for some EDGES of them, so that the rounds over few edges are short."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parts = 1 + both.count() // EDGES
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c")).coalesce(parts), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        jump = step.join(labels.select(F.col("v").alias("c"), F.col("c").alias("far")), "c", "left").select("v", "old", F.least("c", F.coalesce("far", "c")).alias("c"))
        new = written(jump.coalesce(parts), "labels")
        labels = new.select("v", "c")
        if not new.where("old <> c").head(1):
            return labels


def equal_sets(points: DataFrame) -> DataFrame:
    """(doc_id, rep): the documents whose set another one has, too, with the smallest of them."""
    groups = points.where("n > 0").groupBy("point").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    several = written(groups.where("copies > 1").select("point", "rep"), "jaccard-copies")
    member = points.where("n > 0").select("doc_id", "point").join(several, "point")
    return written(member.where("doc_id <> rep").select("doc_id", "rep").distinct(), "jaccard-members")


def named(points: DataFrame, copies: DataFrame, labels: DataFrame | None, rows: DataFrame, plain: bool) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, from the labels of the sets; rows and plain are those of keyed()."""
    # only a document with a copy or a link needs its name looked up
    out = points.select("doc_id", F.col("n").alias("n_shingles")).join(copies.withColumnRenamed("rep", "point_id"), "doc_id", "left")
    out = out.withColumn("point_id", F.coalesce("point_id", "doc_id"))
    if labels is not None:
        out = out.join(labels.select(F.col("v").alias("point_id"), "c"), "point_id", "left").withColumn("point_id", F.coalesce("c", "point_id"))
    out = out.select("doc_id", "n_shingles", F.col("point_id").alias("component_id"))
    if plain:
        return out
    out = written(out.withColumnsRenamed({"doc_id": "key", "component_id": "component"}).join(rows.select("doc_id", "key"), "key"), "jaccard-keys")
    return out.join(out.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "n_shingles", "component_id")


def confirmed(met: DataFrame, points: DataFrame, source: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of met that link: those whose bits allow it, then by the full sets. points: doc_id, n, bits."""
    bits = points.where("n > 0").select("doc_id", "n", "bits")
    near = met.join(bits.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("ys")), "b").join(bits.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xs")), "a")
    pairs = written(near.select("a", "b", "na", "nb", "xs", "ys").mapInArrow(_close(percent), "a long, b long"), "jaccard-close")
    # the texts of the documents in this round's pairs alone: smaller than their sets, which each task makes for itself
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-paired")
    some = only(source, ids, "doc_id")
    full = pairs.join(some.select(F.col("doc_id").alias("b"), F.col("text").alias("ys")), "b").join(some.select(F.col("doc_id").alias("a"), F.col("text").alias("xs")), "a")
    links = written(full.select("a", "b", "xs", "ys").mapInArrow(_linked(k, percent), "a long, b long"), "jaccard-links")
    discard(pairs, ids)
    return links


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(v, c), the component of every document that has a link so far, after more links."""
    if labels is not None:
        name = lambda c: F.coalesce(F.col(f"c{c}"), F.col(c)).alias(c)
        links = links.join(labels.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a", "left").join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b", "left").select(name("a"), name("b")).distinct()
    if not links.head(1):
        return labels
    new = smallest_labels(links)
    if labels is not None:
        moved = labels.join(new.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
        new = moved.unionByName(new.join(labels.select("v"), "v", "left_anti"))
    return written(new, "jaccard-labels")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    rows, plain = keyed(docs)
    source = rows.select(F.col("key").alias("doc_id"), "text")
    points = written(source.mapInArrow(_signatures(k, percent), ", ".join(f"{w} long" for w in SIGNS) + ", doc_id long, n long, bits binary, point binary, head array<long>"), "jaccard-points")
    copies = equal_sets(points)

    first = without(source, copies.select("doc_id"), "doc_id")
    late, rank = pivot_order(points.select(F.explode("head").alias("s")), first, k, percent)
    windows = written(first.mapInArrow(_windows(k, percent, late, rank), "pivot long, doc_id long, n long, place long"), "jaccard-windows")
    shared = windows.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("pivot")
    stored = written(windows.join(shared, "pivot", "left_semi").join(points.select("doc_id", *SIGNS), "doc_id"), "jaccard-regions")
    discard(windows)
    live, labels = stored.withColumn("comp", F.col("doc_id")), None
    draw = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).alias("u")
    share, done = 1, 0
    while True:
        own = live.drop("comp") if labels is None else live.drop("comp", "m", "first", "u").join(labels.withColumnRenamed("v", "doc_id"), "doc_id", "left")
        own = own.withColumn("comp", F.coalesce("c", "doc_id") if labels is not None else F.col("doc_id")).select("pivot", "doc_id", "n", "place", *SIGNS, "comp", draw)
        mixed = own.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("u", "doc_id")).alias("first")).where((F.col("lo") != F.col("hi")) & (F.col("m") > done))  # in smaller ones all were pivots
        mixed = written(mixed.select("pivot", "m", F.col("first.doc_id").alias("first")), "jaccard-mixed")
        before, stored = stored, written(own.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_REGIONS else mixed, "pivot"), "jaccard-live")
        discard(before, mixed)
        live = stored
        most = live.agg(F.max("m")).head()[0]
        if most is None:
            break
        chosen = F.col("doc_id") == F.col("first") if share == 1 else (F.col("u") * F.col("m") < share) & (F.col("u") * F.col("m") >= share // WIDER * (share > WIDER))
        parts = F.ceil(F.col("m") / SPLIT).cast("int")
        p = live.where(chosen).select("pivot", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("comp").alias("cb"), F.col("u").alias("ub"), *(F.col(w).alias(f"{w}b") for w in SIGNS))
        x = live.select("pivot", F.pmod(F.hash("doc_id"), parts).alias("part"), F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("comp").alias("ca"), F.col("u").alias("ua"), *(F.col(w).alias(f"{w}a") for w in SIGNS))
        least = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))  # shingles that a linked pair has in common
        near = (F.col("ca") != F.col("cb")) & ((F.col("ub") < F.col("ua")) | ((F.col("ub") == F.col("ua")) & (F.col("b") < F.col("a"))))
        near &= (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= least)
        near &= (100 + percent) * sum(F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in SIGNS) <= (100 - percent) * (F.col("na") + F.col("nb"))
        met = written(x.join(p, ["pivot", "part"]).where(near).select("a", "b").distinct(), "jaccard-pairs")
        links = confirmed(met, points, source, k, percent)
        discard(met)
        labels = joined(labels, links)
        if share >= most:
            break
        share, done = share * WIDER, share

    return named(points, copies, labels, rows, plain)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM g p JOIN g q USING (s) WHERE p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.c >= 85 * (na.n + nb.n - x.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
