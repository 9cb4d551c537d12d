"""Token ids as Parquet list columns: dictionary-encoded, in row groups and pages of set size with page indexes.

Texts are dealt out by ranges of doc_id (rows of equal doc_id by a hash of the text, so one repeated id does not fill
one range), sorted, encoded by the tokenizers library and written. Each row holds doc_id, part, local_start (ids of the
documents before it in its part), n_tokens and ids; so metadata is read without the ids, and some documents' ids are read
by pushing a doc_id filter down to row groups and pages. White space is never inside a token of this vocabulary, so each
Python worker lets the library's merges encode each chunk between white space and certain cuts once, remembers it while in
use, and gathers the ids (see tokenizer.py).

Defined cases: null and empty texts hold the end id alone; repeated rows are written again, next to each other; a null
doc_id comes first; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, scratch, texts
from .tokenizer import PIECE, worker_bpe

END = 2
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encode(vocabulary: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = worker_bpe(public_tokenizers.path(vocabulary))[1], TaskContext.get().partitionId(), 0
        for batch in (p for b in batches for p in pieces(b, "text", PIECE)):
            ids, bounds = coder.ids(batch.column("text"))
            count, rows = np.diff(bounds) + 1, len(bounds) - 1
            upto = np.concatenate([[0], np.cumsum(count)])
            flat = np.full(int(upto[-1]), end, np.int32)
            last = np.zeros(len(flat), bool)
            last[upto[1:] - 1] = True
            flat[~last] = ids
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "part": pa.array(np.full(rows, part, np.int32)), "local_start": pa.array(start + upto[:-1]),
                "n_tokens": pa.array(count), "ids": pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(flat)),
            })
            start += int(upto[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end: int = END, row_group_bytes: int = 16 << 20, page_rows: int = 2_000) -> None:
    """Writes the token files to path, in ascending doc_id order."""
    spark = docs.sparkSession
    source = texts(docs).withColumn("tie", F.xxhash64("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = source.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("tie")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "text")
    out = dealt.mapInArrow(_encode(vocabulary, end), SCHEMA)
    options = {"parquet.block.size": row_group_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}
    out.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids from the files; with first and last only documents in that range (their pages alone
    are read). The start of a part is the sum over the parts before it, from the metadata columns; there are as many
    parts as the files were written with, so the small table of their starts is bounded and broadcast."""
    from pyspark.sql import Window

    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    for bound, keep in ((first, F.col("doc_id") >= F.lit(first)), (last, F.col("doc_id") <= F.lit(last))):
        rows = rows if bound is None else rows.where(keep)
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("ids")
        flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[at[i] : at[i + 1]].tobytes()) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "start": b.column("start"), "n_tokens": b.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())})


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
