"""Target-distribution importance resampling: draws documents in proportion to how likely a target set makes their n-grams.

Features are the runs of 1 to `order` words, hashed into a fixed number of buckets by crc32. Each slice of a batch interns its
features in an open-addressed NumPy table (xxhash64 keys, bytes compared before a slot is shared); the slots hold bucket and
count. Counts by bucket are summed in each task before they are shuffled, so at most `buckets` rows leave a task. From the sums of the documents and of
the target comes one gain for each bucket, and in a second pass the slot ids of the occurrences gather the gains of a text.
A document's weight is the floored mean of its gains; weight plus Gumbel noise from a hash of doc_id is its score, and the
highest scores are drawn, which samples without replacement in proportion to exp(weight).

The rank is an ordinal over ranges of the score (tessera.operators.ordinals); no task sorts all documents.

Defined cases: null and empty texts and texts without a word have no features and weight 0; a null doc_id has no score, is not
counted among the documents to draw from and is not drawn; rows with equal doc_id have equal noise and each is a document; ties
go to the smaller doc_id; other columns are ignored; an empty table gives no rows, and an empty target counts nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ordinals import numbered

from .common import buffers, pieces, texts, written
from .ngrams import Slots, crc32, runs_of, word_slices


def _slots(b: pa.RecordBatch, order: int, buckets: int) -> Iterator[tuple[Slots, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice: its table, each slot's bucket, the rows of the occurrences, the rows of the new words."""
    data, bounds = buffers(b.column("text"))
    for buf, start, end, row, fresh in word_slices(data, bounds, order - 1):
        s, e, of_row = runs_of(start, end, row, fresh, order)
        table = Slots(buf, s, e)
        yield table, crc32(buf, table.start, table.end) % buckets, of_row, row[fresh:]


def _counts(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in pieces(batch, "text"):
                for table, bucket, _, _ in _slots(b, order, buckets):
                    total += np.bincount(bucket, table.count, buckets).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used), "n": pa.array(total[used])})

    return run


def _weights(order: int, buckets: int, gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                n, total, words = (np.zeros(b.num_rows, np.int64) for _ in range(3))
                for table, bucket, row, word_row in _slots(b, order, buckets):
                    first = np.flatnonzero(np.diff(row, prepend=-1))  # rows come in order within the runs of one length
                    np.add.at(total, row[first], np.add.reduceat(gain[bucket][table.of], first) if len(first) else 0)
                    n += np.bincount(row, minlength=b.num_rows)
                    words += np.bincount(word_row, minlength=b.num_rows)
                weight = np.floor_divide(total, np.maximum(n, 1))
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "n_features": pa.array(n), "n_words": pa.array(words), "weight": pa.array(weight)})

    return run


def bucket_counts(docs: DataFrame, order: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket."""
    rows = texts(docs).mapInArrow(_counts(order, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares, rounded down."""
    s, t, m = source.astype(np.float64), target.astype(np.float64), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (source.sum() + m) / ((s + 1) * (target.sum() + m)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, order: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where a document isn't drawn."""
    named = target.withColumn("doc_id", F.lit(None).cast("long"))
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(named, order, buckets))
    rows = texts(docs).mapInArrow(_weights(order, buckets, gain), "doc_id long, n_features long, n_words long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    can = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    scored = written(rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), can.alias("can")), "resample-scores")
    drawn = scored.agg(F.count_if("can")).head()[0] * percent // 100
    placed = numbered(scored, [F.desc("can"), F.desc("score"), F.asc("doc_id")], "place")  # those that can be drawn come first
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = """
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
f AS (
  SELECT kind, id, unnest(ws) AS f FROM w
  UNION ALL SELECT kind, id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
h AS (SELECT f, hex(f) AS x, strlen(f) AS n FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) % 10000 AS bucket FROM h, crc),
n AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f JOIN b USING (f) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
d AS (SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY id),
s AS (SELECT w.id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS can,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN d USING (id) WHERE kind = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id) AS place, count(*) FILTER (can) OVER () AS total FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND place <= 25 * total // 100 THEN place END AS rank FROM r
"""
