"""MinHash near-dedup by an LSH forest: sorted signature orders, neighbours by longest common prefix, depth by region.

A tree of the forest orders all documents by a signature of MinHash values of their shingle sets, 16 bits each. Two documents
whose sets have similarity t agree in the first d values of a tree with probability t**d; a forest of depth d has so many trees
that a linked pair agrees in none of them with a probability below MISS (22 trees of 4 values for 0.85).

* Orders. The signatures of all trees are sorted by ranges of (region, rest of the signature, document), where a region is a tree
  with the first d values, so a region of any size is spread over tasks. A document is compared with the smallest of the documents
  that begin its regions, which joins a group of near copies by one comparison a member.
* Regions. Where a region still holds more than one component, its documents outside its largest component are compared with
  all of it, if they are at most FEW. In a region with more a document is compared with its neighbour in the order, with which it
  has the longest prefix in common, and the region goes deeper: its documents, and only these, get a forest of their own
  with DEEPER values more and the trees that this takes, in which a dense region falls apart; so depth adapts to the region.
  In the last forest each region is compared in whole, so nothing is left out. Pairs of one component are never compared.

Every candidate is settled on the full sets: first by bits that bound the difference of two sets, then exactly. Documents with equal
sets are one point. A result can only miss a link with a probability of MISS, where its documents meet through no other.

Defined cases: a null or empty text and one without words have n_shingles 0, link with nothing and stay; texts of one to k - 1 words
have one shingle; each row is a document, also where doc_ids repeat or rows are equal, so all rows of the component's
smallest doc_id are kept; a null doc_id names a component only where it has no other and is kept only then; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constants, discard, keyed, mix, only, pieces, release, without, written
from .jaccard_join import PARITY, confirmed, equal_sets, joined, named, parity, shingle_sets

#: The probability that a forest misses a pair at the least similarity that links.
MISS = 1e-7
#: Values of the regions of the first forest; how many more the next ones have; how many a signature has after those of its region.
DEPTH, DEEPER, TAIL, FORESTS = 4, 4, 4, 3
#: Documents outside a region's largest component that are compared with all of the region.
FEW = 256
#: Rows of a region that one task compares with those few; mixed regions that a join may broadcast, some 4 MB.
SPLIT, BROADCAST_REGIONS = 4096, 100_000
#: Bits that bound how much two sets differ and that a row carries, as longs, so that few pairs come to exist.
ROW_BITS = 256
SIGNS = [f"w{i}" for i in range(ROW_BITS // 64)]


def trees(depth: int, percent: int) -> int:
    """How many trees of that depth miss a pair with a probability below MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** depth))


def minhashes(sets: list[np.ndarray], depth: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tree, region, tail) for each tree: of each set its region's number, and the next TAIL values in one. Sets aren't empty."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0] + [len(x) for x in sets[:-1]])
    step = depth + TAIL
    factor = constants(trees(depth, percent) * step, 16 + depth) | np.uint64(1)
    for t in range(trees(depth, percent)):
        region, tail = np.full(len(sets), t, np.uint64), np.zeros(len(sets), np.uint64)
        for j in range(step):
            least = np.minimum.reduceat(flat * factor[t * step + j], begin)
            value = mix(least) >> np.uint64(48)
            if j < depth:
                region = mix(region * np.uint64(0x9E3779B97F4A7C15) + value)
            else:
                tail = tail << np.uint64(16) | value
        yield t, region, tail


def _points(k: int):
    """(doc_id, n, bits, point, signs) of each text, as in the Jaccard join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for b in pieces(batch, "text"):
                sets = shingle_sets(b.column("text"), k)
                signs = np.frombuffer(b"".join(parity(x, ROW_BITS) for x in sets), np.int64).reshape(len(sets), len(SIGNS))
                yield pa.RecordBatch.from_pydict({
                    **{w: pa.array(signs[:, i]) for i, w in enumerate(SIGNS)}, "doc_id": b.column("doc_id"), "n": pa.array([len(x) for x in sets], pa.int64()), "bits": pa.array([parity(x, PARITY) for x in sets], pa.binary()),
                    "point": pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                })

    return run


def _signatures(k: int, depth: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for b in pieces(batch, "text"):
                sets = shingle_sets(b.column("text"), k)
                some = np.array([len(x) > 0 for x in sets])
                if not some.any():
                    continue
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)[some]
                for _, region, tail in minhashes([x for x in sets if len(x)], depth, percent):
                    yield pa.RecordBatch.from_pydict({"region": pa.array(region.view(np.int64)), "tail": pa.array(tail.view(np.int64)), "doc_id": pa.array(ids)})

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows those whose region has another row, with the document before each in its region, which has the longest prefix
    in common with it or with the next, and with the region's first document in this task. The first and the last region of a task
    may go on in others, so their rows stay in any case."""
    last: tuple | None = None  # the row before this batch, not given out yet: region, doc, stays, prev, has, lead
    for b in batches:
        if not b.num_rows:
            continue
        region, doc = (b.column(c).to_numpy().astype(np.int64) for c in ("region", "doc_id"))
        edge = last is None
        if last is not None:
            region, doc = (np.concatenate([[x], y]) for x, y in zip(last[:2], (region, doc), strict=True))
        same = region[1:] == region[:-1]
        has = np.concatenate([[False], same])
        stay = has | np.concatenate([same, [False]])
        prev = np.concatenate([[-1], np.where(same, doc[:-1], -1)])
        lead = doc[np.maximum.accumulate(np.where(has, 0, np.arange(len(doc))))]
        if last is None:
            stay[region == region[0]] = True
        else:
            lead[np.cumsum(~has) == 1] = last[5]
            stay[0] |= last[2]
            prev[0], has[0] = last[3:5]
        yield _rows(region, doc, prev, has, lead, np.flatnonzero(stay[:-1]))
        last = (region[-1], doc[-1], bool(stay[-1] or edge and region[-1] == region[0]), prev[-1], has[-1], lead[-1])
    if last is not None:
        yield _rows(*(np.array([x]) for x in (*last[:2], *last[3:])), np.arange(1))


def _rows(region, doc, prev, has, lead, pick) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"region": pa.array(region[pick]), "doc_id": pa.array(doc[pick]), "prev": pa.array(prev[pick], mask=~has[pick].astype(bool)), "lead": pa.array(lead[pick])})


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (doc_id is component_id)."""
    rows, plain = keyed(docs)
    source = rows.select(F.col("key").alias("doc_id"), "text")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = written(source.mapInArrow(_points(k), ", ".join(f"{w} long" for w in SIGNS) + ", doc_id long, n long, bits binary, point binary"), "forest-points")
    copies = equal_sets(points)
    known = points.where("n > 0").select("doc_id", "n", *SIGNS)
    labels, live = None, without(source, copies.select("doc_id"), "doc_id")

    def settle(labels: DataFrame | None, pairs: DataFrame) -> DataFrame | None:
        """The components after those of the pairs (x, y) that link."""
        met = written(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "forest-pairs")
        if met.head(1):
            labels = joined(labels, confirmed(met, points, source, k, percent))
        discard(met)
        return labels

    as_ = lambda df, x: df.withColumnsRenamed({"doc_id": x, "n": f"n{x}", "comp": f"c{x}"} | {w: f"{w}{x}" for w in SIGNS})
    apart = sum(F.bit_count(F.col(f"{w}x").bitwiseXOR(F.col(f"{w}y"))) for w in SIGNS)
    near = (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")) & ((100 + percent) * apart <= (100 - percent) * (F.col("nx") + F.col("ny")))
    for forest in range(FORESTS):
        depth, last = DEPTH + forest * DEEPER, forest == FORESTS - 1
        signs = written(live.mapInArrow(_signatures(k, depth, percent), "region long, tail long, doc_id long"), "forest-signatures")
        by = ["region", "tail", "doc_id"]
        order = signs.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_neighbours, "region long, doc_id long, prev long, lead long")
        # one row a document, with its place in each tree: as many as there are trees at most
        orders = order.groupBy("doc_id").agg(F.collect_list(F.struct("region", "prev")).alias("places"), F.min("lead").alias("lead"))
        orders = written(orders.join(known, "doc_id"), "forest-orders")
        discard(signs)

        # the smallest of the first documents of its regions: most of a group meet one of a few
        ask = as_(orders.where("lead <> doc_id").drop("places"), "x").withColumnRenamed("lead", "y")
        labels = settle(labels, ask.join(as_(known, "y"), "y").where(near))

        # regions that hold several components still
        of = orders.drop("lead").withColumn("comp", F.col("doc_id"))
        if labels is not None:
            of = of.join(labels.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("c", "doc_id")).drop("c")
        of = of.withColumn("p", F.explode("places")).select("p.region", "p.prev", "doc_id", "n", "comp", *SIGNS)
        by_comp = of.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("m"))
        mixed = by_comp.groupBy("region").agg(F.sum("m").alias("m"), F.max(F.struct("m", "comp")).alias("top")).where("m > top.m")
        mixed = written(mixed.select("region", "m", F.col("top.comp").alias("most"), ((F.col("m") - F.col("top.m") <= FEW) | F.lit(last)).alias("few")), "forest-mixed")
        several, dense = mixed.agg(F.count(F.lit(1)), F.count_if(~F.col("few"))).head()
        if not several:
            discard(orders, mixed)
            break
        here = written(of.join(F.broadcast(mixed) if several <= BROADCAST_REGIONS else mixed, "region"), "forest-members")
        # the documents outside the largest component with all of the region; of dense regions the neighbours alone, the rest goes deeper
        parts_of = F.ceil(F.col("m") / SPLIT).cast("int")
        own = here.where("few").drop("prev")
        x = as_(own.where("comp <> most").withColumn("part", F.explode(F.sequence(F.lit(0), parts_of - 1))).drop("m", "few"), "x")
        y = as_(own.withColumn("part", F.pmod(F.hash("doc_id"), parts_of)).drop("m", "few", "most"), "y")
        pairs = x.join(y, ["region", "part"]).where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("most")) | (F.col("x") > F.col("y"))) & near).select("x", "y")
        if dense:
            beside = here.where(~F.col("few") & F.col("prev").isNotNull()).select("region", F.col("prev").alias("y"), *(F.col(c) for c in ("doc_id", "n", "comp", *SIGNS)))
            pairs = pairs.unionByName(as_(beside, "x").join(as_(here.where(~F.col("few")).drop("prev", "m", "few", "most"), "y"), ["region", "y"]).where((F.col("cx") != F.col("cy")) & near).select("x", "y"))
        labels = settle(labels, pairs)
        deeper = written(here.where(~F.col("few")).select("doc_id").distinct(), "forest-deeper") if dense else None
        discard(orders, mixed, here)
        if deeper is None:
            break
        live = only(source, deeper, "doc_id")
    out = named(points, copies, labels, rows, plain)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=5, percent=85)


OP13_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM g p JOIN g q USING (s) WHERE p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.c >= 85 * (na.n + nb.n - x.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
