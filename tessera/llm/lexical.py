"""Ranked lexical search: range-maximum sparse tables per posting list and best-first search over intervals of documents.

* Index. Each piece of a batch, at most SEGMENT documents and some 4 MB of text, becomes a segment: its documents in order of length,
  its terms, and a posting list (document, occurrences) for each term. Segments are rows of a Parquet table, so the index lies
  where its documents lay and no term, however frequent, is gathered anywhere.
* Statistics. Documents, terms and the documents that hold an asked term are summed over the segments, in each task first.
* Search. In a segment each asked posting list gets the impacts of its documents and a sparse table of range maxima. The summed
  maxima of an item's lists bound all scores of an interval of documents. Best-first, the intervals of the highest bounds are
  split at the document with the greatest impact in them, which is scored exactly; an interval goes once its bound doesn't beat
  the item's k-th best so far, which a task carries from segment to segment. Of equal scores the smaller doc_id wins, so an
  interval whose bound equals the k-th score goes only if all its doc_ids are larger. The result is exact.

The items are a stated query set: they go to the tasks in blocks of some `block` terms, each block over the whole index.

Defined cases: a null or empty text and one without a term holds nothing and counts nowhere; a document with a null doc_id counts in
the statistics and is never found; rows of one doc_id are documents of their own; repeated item rows give their own
results each, a null item_id is kept as such; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, pieces, release, texts, written
from .ngrams import Slots, word_slices

#: Documents of a segment, so that places in it fit 16 bits; intervals that are split at once.
SEGMENT, WIDTH = 2048, 48
#: Groups of tasks whose results for an item are merged before all of them are.
MERGE = 32
FIELDS = {"doc_ids": np.int64, "named": np.uint8, "n": np.int64, "letters": np.uint8, "lengths": np.uint32, "df": np.uint32, "docs": np.uint16, "tf": np.uint32}
INDEX = "n_docs long, n_terms long, " + ", ".join(f"{c} binary" for c in FIELDS)


def strings(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The spans of a buffer as Arrow strings."""
    off = np.concatenate([[0], np.cumsum(length)])
    data = buf[np.arange(off[-1]) + np.repeat(start - off[:-1], length)]
    return pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def term_counts(col: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, then of each term and row that holds it: term, row, occurrences), sorted by term and row."""
    data, bounds = buffers(col)
    rows = max(1, len(bounds) - 1)
    names, parts, base = [pa.array([], pa.string())], [], 0
    for buf, start, end, row, _ in word_slices(data, bounds, 0, 8 << 20):
        t = Slots(buf, start, end)
        names.append(strings(buf, t.start, t.end - t.start))
        key, n = np.unique((t.of + base) * rows + row, return_counts=True)
        parts.append((key // rows, key % rows, n))
        base += len(t)
    found = pa.concat_arrays(names).dictionary_encode()
    if not parts:
        return found.dictionary, *(np.zeros(0, np.int64) for _ in range(3))
    term, row, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    if len(parts) == 1:
        return found.dictionary, term, row, n
    key, back = np.unique(found.indices.to_numpy()[term].astype(np.int64) * rows + row, return_inverse=True)
    return found.dictionary, key // rows, key % rows, np.bincount(back, n).astype(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for piece in pieces(batch, "text"):
            for i in range(0, piece.num_rows, SEGMENT):
                b = piece.slice(i, SEGMENT)
                names, term, row, tf = term_counts(b.column("text"))
                n = np.bincount(row, tf, b.num_rows).astype(np.int64)
                ids = b.column("doc_id")
                own = ids.fill_null(0).to_numpy()
                order = np.lexsort((own, n))
                order = order[n[order] > 0]
                if not len(order):
                    continue
                place = np.zeros(b.num_rows, np.int64)
                place[order] = np.arange(len(order))
                by = np.lexsort((place[row], term))
                data, off = buffers(names)
                values = {"doc_ids": own[order], "named": ids.is_valid().to_numpy(zero_copy_only=False)[order], "n": n[order], "letters": data[off[0] : off[-1]], "lengths": np.diff(off), "df": np.bincount(term, minlength=len(names)), "docs": place[row][by], "tf": tf[by]}
                yield pa.RecordBatch.from_pydict({"n_docs": pa.array([len(order)]), "n_terms": pa.array([int(n.sum())]), **{c: pa.array([np.ascontiguousarray(v.astype(FIELDS[c])).tobytes()], pa.binary()) for c, v in values.items()}})


def index(docs: DataFrame) -> DataFrame:
    """The segments of all documents."""
    return written(texts(docs).mapInArrow(_segments, INDEX), "lexical-index")


def _terms(row: dict) -> pa.Array:
    length = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    return strings(np.frombuffer(row["letters"], np.uint8), np.cumsum(length) - length, length)


def _held(asked: pa.Array):
    """How many documents hold each of the asked terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for b in batches:
            for row in b.to_pylist():
                at = pc.index_in(asked, value_set=_terms(row)).fill_null(-1).to_numpy()
                total[at >= 0] += np.frombuffer(row["df"], np.uint32)[at[at >= 0]]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(used), "df": pa.array(total[used])})

    return run


def sparse_table(value: np.ndarray, longest: int) -> np.ndarray:
    """Row j has the first place of the greatest value among the 2**j from each place on (at the end: among what is left)."""
    levels = [np.arange(len(value), dtype=np.int32)]
    for j in range(max(0, longest.bit_length() - 1)):
        a = levels[-1]
        b = np.concatenate([a[1 << j :], a[len(a) - min(1 << j, len(a)) :]])
        levels.append(np.where(value[a] >= value[b], a, b))
    return np.stack(levels)


LOG2 = np.zeros(SEGMENT + 2, np.int64)
LOG2[1:] = np.floor(np.log2(np.arange(1, SEGMENT + 2)))


class Segment:
    """A segment's posting lists of the asked terms: weighted impacts, places by document, sparse tables of range maxima."""

    def __init__(self, row: dict, asked: pa.Array, weight: np.ndarray, docs: int, terms: int):
        at = pc.index_in(asked, value_set=_terms(row)).fill_null(-1).to_numpy()
        there = np.flatnonzero(at >= 0)
        self.list_of = np.full(len(asked), -1, np.int64)
        self.list_of[there] = np.arange(len(there))
        df = np.frombuffer(row["df"], np.uint32).astype(np.int64)
        m, begin = df[at[there]], (np.cumsum(df) - df)[at[there]]
        pick = np.arange(m.sum()) + np.repeat(begin - (np.cumsum(m) - m), m)
        doc, tf = np.frombuffer(row["docs"], np.uint16)[pick].astype(np.int64), np.frombuffer(row["tf"], np.uint32)[pick].astype(np.int64)
        own = np.repeat(np.arange(len(there)), m)
        self.ids, n, named = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["n"], np.int64), np.frombuffer(row["named"], np.uint8) > 0
        if not named.all():
            own, doc, tf = own[named[doc]], doc[named[doc]], tf[named[doc]]
        length = 50 + 50 * n * docs // terms
        self.value = weight[there][own] * (1_000_000_000 * tf // (1000 * tf + 20 * length[doc]))
        self.doc = doc
        size = np.bincount(own, minlength=len(there))
        self.begin = np.cumsum(size) - size
        flags = np.zeros((len(there), len(n) + 1), np.uint16)
        flags[own, doc + 1] = 1
        self.before = np.cumsum(flags, axis=1, dtype=np.uint16)  # entries of a list before a document
        self.best = sparse_table(self.value, int(size.max(initial=0)))
        self.least_id = sparse_table(-np.where(named, self.ids, np.iinfo(np.int64).max), len(n))

    def bounds(self, lists: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each interval the sum of the lists' greatest values, and the document with the greatest of them."""
        own = self.before[lists]
        begin = self.begin[lists][:, None]
        a, z = own[:, lo] + begin, own[:, hi] + begin
        j = LOG2[z - a]
        first = self.best[j, np.minimum(a, len(self.value) - 1)]
        last = self.best[j, np.maximum(z - (1 << j), 0)]
        top = np.where(self.value[first] >= self.value[last], first, last)
        value = np.where(a < z, self.value[top], 0)
        return value.sum(axis=0), self.doc[top[value.argmax(axis=0), np.arange(len(lo))]]

    def scores(self, lists: np.ndarray, d: np.ndarray) -> np.ndarray:
        own = self.before[lists]
        at = own[:, d].astype(np.int64)
        return np.where(own[:, d + 1] > at, self.value[np.minimum(at + self.begin[lists][:, None], len(self.value) - 1)], 0).sum(axis=0)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        j = LOG2[hi - lo]
        a, b = self.ids[self.least_id[j, lo]], self.ids[self.least_id[j, hi - (1 << j)]]
        return np.minimum(a, b)

    def search(self, terms: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of (scores, ids), in order, and of this segment for an item's terms."""
        lists = self.list_of[terms]
        lists = lists[lists >= 0]
        if not len(lists) or not len(self.value):
            return scores, ids
        lo, hi = np.zeros(1, np.int64), np.full(1, len(self.ids))
        bound, split = self.bounds(lists, lo, hi)
        while True:
            live = bound > (scores[-1] if len(scores) == k else 0)
            if len(scores) == k:
                tied = np.flatnonzero(bound == scores[-1])
                live[tied] = (bound[tied] > 0) & (self.least(lo[tied], hi[tied]) < ids[-1])
            lo, hi, bound, split = lo[live], hi[live], bound[live], split[live]
            if not len(lo):
                return scores, ids
            order = np.argpartition(-bound, WIDTH) if len(lo) > WIDTH else np.arange(len(lo))
            now, later = order[:WIDTH], order[WIDTH:]
            d = split[now]
            scores, ids = np.concatenate([scores, self.scores(lists, d)]), np.concatenate([ids, self.ids[d]])
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
            a, z = np.concatenate([lo[now], d + 1]), np.concatenate([d, hi[now]])
            a, z = a[a < z], z[a < z]
            b, s = self.bounds(lists, a, z) if len(a) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            lo, hi, bound, split = (np.concatenate(x) for x in ((lo[later], a), (hi[later], z), (bound[later], b), (split[later], s)))


def _search(asked: pa.Array, weight: np.ndarray, items: list[np.ndarray], docs: int, terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        for b in batches:
            for row in b.to_pylist():
                s = Segment(row, asked, weight, docs, terms)
                best = [s.search(own, k, *found) for own, found in zip(items, best, strict=True)]
        size = [len(x) for x, _ in best]
        if sum(size):
            yield pa.RecordBatch.from_pydict({"no": pa.array(np.repeat(np.arange(len(items)), size)), "doc_id": pa.array(np.concatenate([i for _, i in best])), "score": pa.array(np.concatenate([x for x, _ in best]))})

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in pieces(batch, "text"):
            names, term, row, _ = term_counts(b.column("text"))
            order = np.argsort(row, kind="stable")
            off = np.searchsorted(row[order], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id"), "terms": pa.ListArray.from_arrays(pa.array(off), names.take(pa.array(term[order])))})


def search(segments: DataFrame, items: DataFrame, k: int = 50, block: int = 20_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items (item_id, text)."""
    spark = segments.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = written(known.mapInArrow(_item_terms, "item_id long, terms array<string>").where(F.size("terms") > 0), "lexical-items")
    blocks = -(-(known.agg(F.sum(F.size("terms"))).head()[0] or 0) // block)
    sums = segments.agg(F.sum("n_docs"), F.sum("n_terms")).head()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for i in range(blocks if sums[0] else 0):
        own = known.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == i).orderBy("item_id", "terms").toArrow()  # the items of a block
        if not own.num_rows:
            continue
        column = own.column("terms").combine_chunks()
        coded = column.flatten().dictionary_encode()
        asked, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        terms = np.split(codes, np.cumsum(column.value_lengths().to_numpy())[:-1])
        held = segments.select("letters", "lengths", "df").mapInArrow(_held(asked), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
        df = np.zeros(len(asked), np.int64)
        df[held["term"].to_numpy(np.int64)] = held["df"].to_numpy(np.int64)
        weight = np.floor(1000 * np.log((2 * float(sums[0]) + 2) / (2 * df + 1))).astype(np.int64)
        found = segments.select(*FIELDS).mapInArrow(_search(asked, weight, terms, sums[0], sums[1], k), "no long, doc_id long, score long")
        by = [F.desc("score"), F.asc("doc_id")]
        top = lambda df, keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)
        found = top(top(found.withColumn("group", F.spark_partition_id() % MERGE), ["no", "group"]), ["no"])
        names = spark.createDataFrame([(n, v) for n, v in enumerate(own.column("item_id").to_pylist())], "no long, item_id long")
        out = out.unionByName(found.join(F.broadcast(names), "no").select("item_id", "rank", "doc_id", "score"))
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = """
WITH w AS (SELECT kind, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
p AS (SELECT id, t, count(*) AS tf FROM w WHERE kind = 'd' GROUP BY id, t),
d AS (SELECT id, sum(tf)::BIGINT AS n FROM p GROUP BY id),
a AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
m AS (SELECT id, 50 + (50 * n * nd) // l AS m FROM d, a),
f AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, a GROUP BY t, nd),
q AS (SELECT DISTINCT id AS item_id, t FROM w WHERE kind = 'b'),
s AS (SELECT item_id, p.id AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN f USING (t) JOIN m ON m.id = p.id GROUP BY item_id, p.id),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE score > 0)
SELECT item_id, rn::INTEGER AS rank, doc_id, score FROM r WHERE rn <= 50
"""
