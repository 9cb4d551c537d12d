"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling; later copies of repeated runs go.

Each text is a sequence of its lines (those with a word); a line's ID is a 64-bit hash of its bytes. Only lines that occur
twice or more can be in a repeated run, so the suffixes that begin with another are left out at once. Prefix doubling
ranks the others: rank 0 orders single lines, and rank k + 1 orders the pairs (rank k here, rank k 2**k lines on), by a
range-partitioned sort of the distinct pairs; a suffix whose rank is its own is in place. Equal ranks of length 2**k are
the suffix array's LCP intervals of at least 2**k lines; an interval of any length l is that of two overlapping ranks,
2**k <= l < 2**(k + 1), one at its first line and one 2**k lines before its end.

A run of lines is repeated where it also begins earlier, in order of (key, line), where key numbers the rows by doc_id. All lines of maximal repeated runs of
at least `min_words` words are deleted. Such a run is the union of its shortest parts of at least min_words words that
begin at a line or end at one, and each of those is an LCP interval whose first member stays; so one aggregation with
map-side partial sums finds all later copies, and no group of copies is gathered anywhere.

Defined cases: null and empty texts have no lines and stay empty; lines of white space stay where they are; runs may overlap
their own earlier copy; rows with equal doc_id are told apart by their text's hash, and equal rows by a number; a null
doc_id sorts first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import EXACT, NEWLINES, SPACES, buffers, keyed, only, pieces, scratch, spans, texts, written


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line, id, words) of each line that has a word; line counts those of its text from 0."""
    for batch in batches:
        for b in pieces(batch, "text"):
            data, bounds = buffers(b.column("text"))
            start, end, h = spans(data, bounds, NEWLINES, EXACT)
            word, _, _ = spans(data, bounds, SPACES, EXACT)
            n = np.searchsorted(word, end) - np.searchsorted(word, start)
            start, h, n = start[n > 0], h[n > 0], n[n > 0]
            row = np.searchsorted(bounds, start, "right") - 1
            first = np.searchsorted(start, bounds[:-1])
            ids = b.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"key": pa.array(ids[row].astype(np.int64)), "line": pa.array(np.arange(len(start)) - first[row]), "id": pa.array(h.view(np.int64)), "words": pa.array(n)})


def ranked(keys: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct keys with `rank`, a long that orders them: a range-partitioned sort, numbered by part and place."""
    parts = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = keys.distinct().repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    return written(order.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _repeated(rows: DataFrame, min_words: int) -> DataFrame:
    """(key, line) of each line of (key, text) to delete: those in a maximal repeated run of at least min_words words that
    also begins earlier."""
    lines = written(rows.mapInArrow(_lines, "key long, line long, id long, words long"), "lines")
    again = written(lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "line-ids")
    order = ranked(again, ["id"])
    at = written(lines.join(order, "id").select("key", "line", "words", F.col("rank").alias("r0")), "line-suffixes")

    # stretches of repeated lines; within one, words before each line, and the shortest parts of at least min_words words
    from pyspark.sql import Window

    by_doc = Window.partitionBy("key").orderBy("line")
    s = at.withColumn("stretch", F.col("line") - F.row_number().over(by_doc))
    own = Window.partitionBy("key", "stretch").orderBy("line")
    s = s.withColumn("upto", F.sum("words").over(own)).withColumn("before", F.col("upto") - F.col("words"))
    # forward: lines from here until min_words are reached, by the range of running sums; backward: the mirror of it
    ahead = Window.partitionBy("key", "stretch").orderBy("before").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy("key", "stretch").orderBy("upto").rangeBetween(-(min_words - 1), 0)
    whole = Window.partitionBy("key", "stretch")
    s = s.withColumn("total", F.sum("words").over(whole))
    s = s.withColumn("l_ahead", F.when(F.col("total") - F.col("before") >= min_words, F.count(F.lit(1)).over(ahead))).withColumn("l_behind", F.when(F.col("upto") >= min_words, F.count(F.lit(1)).over(behind)))
    parts = s.select("key", "line", F.explode(F.array(F.struct(F.col("line").alias("a"), F.col("l_ahead").alias("l")), F.struct((F.col("line") - F.col("l_behind") + 1).alias("a"), F.col("l_behind").alias("l")))).alias("p"))
    parts = written(parts.where("p.l is not null").select("key", F.col("p.a").alias("a"), F.col("p.l").alias("l")).distinct(), "line-parts")
    longest = parts.agg(F.max("l")).head()[0] or 0

    k, levels, current = 0, [at.select("key", "line", F.col("r0").alias("r"))], at.select("key", "line", F.col("r0").alias("r"))
    while 2 << k <= longest:
        behind_k = current.select("key", (F.col("line") - (1 << k)).alias("line"), F.col("r").alias("r2"))
        pairs = current.join(behind_k, ["key", "line"])
        several = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r", "r2")  # a rank of its own is in place
        order = ranked(several, ["r", "r2"])
        current = written(pairs.join(order, ["r", "r2"]).select("key", "line", F.col("rank").alias("r")), f"line-rank-{k + 1}")
        levels.append(current)
        k += 1

    gone = None
    for j, level in enumerate(levels):
        here = parts.where((F.col("l") >= 1 << j) & (F.col("l") < 2 << j))
        both = here.join(level.select("key", F.col("line").alias("a"), F.col("r").alias("x")), ["key", "a"])
        both = both.withColumn("b", F.col("a") + F.col("l") - (1 << j)).join(level.select("key", F.col("line").alias("b"), F.col("r").alias("y")), ["key", "b"]).select("key", "a", "l", "x", "y")
        first = both.groupBy("l", "x", "y").agg(F.min(F.struct("key", "a")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        later = both.join(first, ["l", "x", "y"]).where("struct(key, a) > first").select("key", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("l") - 1)).alias("line"))
        gone = later if gone is None else gone.unionByName(later)
    return gone.distinct()


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, key, line) of each line to delete; key tells rows of one doc_id apart (see keyed)."""
    rows, _ = keyed(docs)
    return rows.select("doc_id", "key").join(_repeated(rows, min_words), "key").select("doc_id", "key", "line")


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (p for batch in batches for p in pieces(batch, "text")):
        out = []
        for text, drop in zip(b.column("text").to_pylist(), b.column("lines").to_pylist(), strict=True):
            gone, i, kept = set(drop or ()), 0, []
            for x in text.split("\n"):
                has_word = bool(x.strip(" \t\r\x0b\x0c"))
                if not (has_word and i in gone):
                    kept.append(x)
                i += has_word
            out.append("\n".join(kept))
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text": pa.array(out, pa.string()), "n_removed": pa.array([len(x or ()) for x in b.column("lines").to_pylist()], pa.int64())})


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, text without later copies of repeated runs, n_removed, of every input row."""
    from .common import without

    source, _ = keyed(docs)
    drop = written(_repeated(source, min_words).groupBy("key").agg(F.array_sort(F.collect_list("line")).alias("lines")), "line-drops")  # lines of one text
    ids = drop.select("key")
    changed = only(source, ids, "key").join(drop, "key").select("doc_id", "text", "lines").mapInArrow(_clean, "doc_id long, text string, n_removed long")
    return changed.unionByName(without(source, ids, "key").select("doc_id", "text", F.lit(0).cast("long").alias("n_removed")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
