"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contained in a document when at least `percent` per cent of its distinct shingles of k words are among the
document's. Items are partitioned by size into classes [2**j, 2**(j+1)). Each item keeps its bottom-m MinHash sketch,
m = 1 + the most shingles that an item of the class may miss; so at least one sketch value lies in every document that
contains the item, and the search loses nothing. Documents with fewer shingles than the smallest item of a class needs
skip that class. A document's shingles meet the sketches through a bit table of fixed size first; the few that remain
name candidate items, whose containment is then counted exactly on the full sets.

The items go to the tasks in blocks of at most `block` shingles (a stated query set against all rows), one pass over the
documents for each block, so what is sent to a task has a fixed bound however many items there are.

Defined cases: null or empty texts and texts of fewer than k words match nothing, as items and as documents; repeated
items and repeated documents give their own rows; rows with a null item_id match nothing; a null doc_id is kept as such;
other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, release, shingles, texts, without, words, written

BITS = 22
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long"


def _item_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, bounds = words(b.column("text"))
            s, at = shingles(h, bounds, k)
            sets = [np.unique(s[at[i] : at[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id"), "n": pa.array([len(x) for x in sets], pa.int64()), "members": pa.array([x.tobytes() for x in sets], pa.binary())})

    return run


def _index(sets: list[np.ndarray], percent: int):
    """Sketch values in order with their items, the items' needs, and the bit table."""
    size = np.array([len(x) for x in sets])
    top = 2 << np.floor(np.log2(size)).astype(np.int64)  # the end of an item's size class
    sketch = np.minimum(size, (100 - percent) * top // 100 + 1)
    values, items = np.concatenate([x[:m] for x, m in zip(sets, sketch, strict=True)]), np.repeat(np.arange(len(sets)), sketch)
    order = np.argsort(values, kind="stable")
    bits = np.zeros(1 << BITS, dtype=bool)
    bits[(values & np.uint64((1 << BITS) - 1)).astype(np.int64)] = True
    need = -(-size * percent // 100)
    return values[order], items[order], need, bits


def _search(ids: list[int], sets: list[np.ndarray], k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        values, items, need, bits = _index(sets, percent)
        least = need.min()
        for batch in batches:
            out: list[tuple[int | None, int, int, int]] = []
            for b in pieces(batch, "text"):
                h, bounds = words(b.column("text"))
                s, at = shingles(h, bounds, k)
                hit = np.flatnonzero(bits[(s & np.uint64((1 << BITS) - 1)).astype(np.int64)])
                low = np.searchsorted(values, s[hit], "left")
                hit = hit[(low < len(values)) & (values[np.minimum(low, len(values) - 1)] == s[hit])]
                for d in np.unique(np.searchsorted(at, hit, "right") - 1):
                    if at[d + 1] - at[d] < least:
                        continue
                    own = np.unique(s[at[d] : at[d + 1]])
                    lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                    for i in np.unique(np.concatenate([items[a:z] for a, z in zip(lo, hi, strict=True) if a < z])):
                        if len(own) >= need[i]:
                            shared = int((own[np.minimum(np.searchsorted(own, sets[i]), len(own) - 1)] == sets[i]).sum())
                            if shared >= need[i]:
                                out.append((b.column("doc_id")[int(d)].as_py(), ids[i], len(sets[i]), shared))
            if out:
                yield pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in out], pa.int64()) for j, c in enumerate(("doc_id", "item_id", "n_item", "n_shared"))})

    return run


def contained(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, block: int = 2_000_000) -> DataFrame:
    """One row (doc_id, item_id, n_item, n_shared) for each document and item with n_shared >= percent % of n_item."""
    source, spark = texts(docs), docs.sparkSession
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    known = written(known.mapInArrow(_item_sets(k), "item_id long, n long, members binary").where("n > 0"), "items")
    blocks = -(-(known.agg(F.sum("n")).head()[0] or 0) // block)
    found = spark.createDataFrame([], SCHEMA)
    for i in range(blocks):
        part = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item_id", "members"), F.lit(blocks)) == i)  # every item is in one of the blocks
        rows = part.select("item_id", "members").orderBy("item_id", "members").toArrow()
        if rows.num_rows:
            sets = [np.frombuffer(x.as_buffer(), np.uint64).copy() for x in rows.column("members")]
            found = found.unionByName(source.mapInArrow(_search(rows.column("item_id").to_pylist(), sets, k, percent), SCHEMA))
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents that contain no item, with their columns as they are."""
    bad = written(contained(docs, items, k, percent).select("doc_id").where("doc_id is not null").distinct(), "contaminated")
    return without(docs, bad, "doc_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = """
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') FROM benchmark),
g AS (SELECT DISTINCT kind, id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM (SELECT kind, id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
n AS (SELECT id, count(*) AS n FROM g WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_item, count(*) AS n_shared
FROM g d JOIN g i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n HAVING 100 * count(*) >= 80 * n.n
"""
