"""What the corpus operators share: scratch tables, id restriction, vectorised span hashing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that a join may broadcast: 2 million longs, some 32 MB on each executor. Above it the join shuffles.
BROADCAST_IDS = 2_000_000
#: Bytes of an Arrow batch. Texts are long: at Spark's own 64 MB and 10,000 rows two tasks of an executor take hundreds of MB.
BATCH, SPARK_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m"), ("67108864b", "64m", "64MB")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new temporary folder if the
    driver is the only machine, else one in the warehouse, which is shared too."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        base = "file://" + tempfile.mkdtemp(prefix="tessera-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessera"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of any documents table; a null text is an empty one. Python tasks get it in batches of
    some 8 MB, unless the session has a bound of its own."""
    conf = docs.sparkSession.conf
    if conf.get(BATCH[0], SPARK_BATCH[0]) in SPARK_BATCH:
        conf.set(*BATCH)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, text, key) of every row, and whether key is doc_id: it is where that is unique and never null. Else the rows
    are sorted by doc_id (null first), the text's hash and number among equals, and written with their place as the key."""
    source = texts(docs)
    if source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return source.withColumn("key", F.col("doc_id")), True
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = ["doc_id", "hash", "number"]
    order = source.withColumn("hash", F.sha2("text", 256)).withColumn("number", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return written(order.select("doc_id", "text", F.monotonically_increasing_id().alias("key")), "keys"), False


def only(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of df whose key is in ids: ids are counted, and broadcast up to limit, else shuffled."""
    n = ids.count()
    return df.join(F.broadcast(ids) if n <= limit else ids.hint("merge"), key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows of df whose key is not in ids (a null key stays)."""
    n = ids.count()
    return df.join(F.broadcast(ids) if n <= limit else ids.hint("merge"), key, "left_anti")


#: What this Python worker keeps from task to task, by operator.
HELD: list[dict] = []


def release() -> None:
    """Gives up what other operators keep in this Python worker, which Spark uses again, and returns free memory to the system."""
    for cache in HELD:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


# ---- hashing of words and lines, without a Python object for each -------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place (the public splitmix64 constants)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15))


SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINES = np.zeros(256, dtype=bool)
NEWLINES[0x0A] = True
EXACT = constants(256, 1)
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]
STEP = constants(16, 2) | np.uint64(1)


@lru_cache(maxsize=2)
def factors(n: int) -> np.ndarray:
    """An odd factor for each place in a word, for n places. They are unrelated to each other: with powers of a base, words of two
    letters that are each other with the letters swapped could be equal in every base."""
    return constants(n, 3) | np.uint64(1)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.dtype(np.int64 if wide else np.int32)
    bounds = np.frombuffer(off, kind, len(col) + 1, col.offset * kind.itemsize).astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def _cut(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray, at: int) -> int:
    """The first place from at on where no span is cut in two: a separator or the end of a row."""
    last = int(bounds[np.searchsorted(bounds, at)])
    while at < last:
        found = sep[data[at : min(last, at + 65536)]]
        if found.any():
            return at + int(found.argmax())
        at += len(found)
    return last


def spans(data: np.ndarray, bounds: np.ndarray, sep: np.ndarray = SPACES, table: np.ndarray = FOLDED, size: int = 1 << 18, kinds: np.ndarray | None = None):
    """Maximal runs of non-separator bytes within the rows: (start, end, 64-bit hash). Works through slices of
    about `size` bytes, so temporary memory doesn't depend on the batch or the length of a text. With kinds, runs are cut
    between two bytes of different kinds above 0, and between two bytes of kind 3."""
    starts, ends, hashes = [], [], []
    a, stop = int(bounds[0]), int(bounds[-1])
    while a < stop:
        b = a + size
        b = stop if b >= stop else _cut(data, bounds, sep, b)
        d = data[a:b]
        inside = ~sep[d]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        if kinds is not None:
            k = kinds[d]
            apart = (k[1:] > 0) & (k[:-1] > 0) & ((k[1:] != k[:-1]) | (k[1:] == 3))
            first[1:] |= apart
            last[:-1] |= apart
        cut = bounds[np.searchsorted(bounds, a, "right") : np.searchsorted(bounds, b, "left")] - a
        cut = cut[(cut > 0) & (cut < len(d))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        length = e - s
        begin = np.cumsum(length) - length
        factor = factors(1 << max(10, int(length.max(initial=0)).bit_length()))
        place = np.arange(begin[-1] + length[-1] if len(s) else 0) - np.repeat(begin, length)
        h = np.add.reduceat(table[d[inside]] * factor[place], begin) if len(s) else np.zeros(0, np.uint64)
        h += length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(h))
        a = b
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, split at \\x20 and \\x09-\\x0D) of each row, and the rows' bounds in them."""
    data, bounds = buffers(col)
    start, _, h = spans(data, bounds)
    return h, np.searchsorted(start, bounds)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within each row, and the rows' bounds in them; a row of fewer words has none."""
    count = np.maximum(np.diff(bounds) - k + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.arange(out[-1], dtype=np.int64) + np.repeat(bounds[:-1] - out[:-1], count)
    total = h[at] * STEP[0]
    for j in range(1, k):
        total += h[at + j] * STEP[j]
    return mix(total), out


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 << 20):
    """The batch in parts of about `size` bytes of text, at least one row each."""
    _, bounds = buffers(batch.column(batch.schema.get_field_index(column)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
