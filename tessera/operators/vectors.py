"""k-nearest-neighbour search by cosine: exact over all rows, or over the nearest cells of a partitioned index.

Tasks compare a bounded block of vectors with a bounded block of queries by one matrix product and keep the best k of their
rows for each query, in the order of the answer (rounded cosine, then vec_id), so any number of ties is settled exactly; a
window merges them. Up to `block` queries go out to where the vectors lie; more meet the vectors in a grid of
(part of the vectors, part of the queries), in one job however many queries there are.

Vectors count where vec_id isn't null and the embedding has the queries' length and only numbers; other rows are no neighbours
and no queries. The queries' length is that of the query with the least vec_id that has one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Queries, and vectors, that a task compares at a time; what stands for the similarity of a row to itself, in millionths.
SLICE, SELF = 512, -2_000_000
#: Vectors of a part of the grid or of a cell's file; vectors that the cells' centres are learned from; the most cells.
PART, SAMPLE, CELLS = 16_384, 65_536, 4_096
#: The thresholds of the ladder with the names of its rungs.
LADDER = ((0.85, "high_similarity"), (0.7, "medium_similarity"), (0.5, "low_similarity"))
FOUND = "query_id long, vec_id long, similarity double"


@dataclass(frozen=True)
class Filters:
    """What a query may ask of its neighbours: equal values of the columns `same`, and a value of `within` between its own
    {within}_min and {within}_max. A null of the query asks for nothing; a null of a row meets no demand."""

    same: tuple[str, ...] = ()
    within: str | None = None

    def of_rows(self) -> list[Column]:
        return [F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(self.same)] + ([F.col(self.within).cast("double").alias("at")] if self.within else [])

    def of_queries(self) -> list[Column]:
        own = [F.col(f"{self.within}_{e}").cast("double").alias(e) for e in ("min", "max")] if self.within else []
        return [F.col(c).cast("string").alias(f"s{i}") for i, c in enumerate(self.same)] + own

    def out(self, q: pa.Table, v: pa.Table) -> np.ndarray | None:
        """Where a query (row) can't have a vector (column)."""
        out = None
        for i in range(len(self.same)):
            names = pc.unique(q.column(f"s{i}")).drop_null()
            a, b = (pc.index_in(t.column(f"s{i}"), value_set=names).fill_null(-1).to_numpy() for t in (q, v))
            no = (a[:, None] >= 0) & (a[:, None] != b[None, :])
            out = no if out is None else out | no
        if self.within:
            lo, hi, at = (t.column(c).to_numpy().astype(float) for t, c in ((q, "min"), (q, "max"), (v, "at")))  # null: nan
            no = ~(np.isnan(lo)[:, None] | (at[None, :] >= lo[:, None])) | ~(np.isnan(hi)[:, None] | (at[None, :] <= hi[:, None]))
            out = no if out is None else out | no
        return out


def _unit(col: pa.ChunkedArray, width: int) -> np.ndarray:
    v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in col.chunks] or [np.zeros(0)]).astype(np.float64).reshape(-1, width)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _best(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row of whole numbers; of equal ones the first columns."""
    width = sim.shape[1]
    if k >= width:
        return np.tile(np.arange(width), (len(sim), 1))
    return np.argpartition(np.arange(width) - sim * width, k - 1, axis=1)[:, :k]  # no two keys are equal


def _nearest(v: pa.Table, q: pa.Table, k: int, width: int, filters: Filters) -> Iterator[pa.RecordBatch]:
    """The best k of the vectors for each query, of which a slice of either side is compared at a time."""
    v = v.take(pa.array(np.argsort(v.column("vec_id").to_numpy(), kind="stable")))
    own = v.column("vec_id").to_numpy()
    for i in range(0, q.num_rows, SLICE):
        some = q.slice(i, SLICE)
        ids, asked = some.column("vec_id").to_numpy(), _unit(some.column("embedding"), width)
        near, at = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0), np.int64)  # by vec_id, as the vectors are
        for j in range(0, v.num_rows, SLICE):
            part = v.slice(j, SLICE)
            sim = asked @ _unit(part.column("embedding"), width).T * 1e6
            sim = np.trunc(sim + np.copysign(0.5, sim)).astype(np.int64)  # as round(x, 6) of the SQL
            sim[ids[:, None] == own[None, j : j + SLICE]] = SELF
            no = filters.out(some, part)
            if no is not None:
                sim[no] = SELF
            near, at = np.hstack([near, sim]), np.hstack([at, np.broadcast_to(np.arange(j, j + part.num_rows), sim.shape)])
            best = np.sort(_best(near, k), axis=1)
            near, at = np.take_along_axis(near, best, axis=1), np.take_along_axis(at, best, axis=1)
        row, use = np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel() > SELF
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[row][use]), "vec_id": pa.array(own[at.ravel()][use]), "similarity": pa.array(near.ravel()[use] / 1e6)})


def _sound(df: DataFrame) -> DataFrame:
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def _width(queries: DataFrame) -> int | None:
    return _sound(queries).agg(F.min_by(F.size("embedding"), "vec_id")).head()[0]


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _grid(v: DataFrame, q: DataFrame, keys: list[str], k: int, width: int, filters: Filters) -> DataFrame:
    """Vectors and queries that meet where their keys are equal."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = list(_nearest(left, right, k, width, filters)) if left.num_rows and right.num_rows else []
        return pa.Table.from_batches(batches, pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("similarity", pa.float64())]))

    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(pair, FOUND)


def _split(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n))))


def _each(df: DataFrame, n: int, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, n) - 1).cast("long"))))


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4096, same: str | Sequence[str] | None = None, within: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k most similar other rows of each query (ties by vec_id), among those that its
    filters allow (see Filters)."""
    spark, width = vectors.sparkSession, _width(queries)
    if width is None:
        return _merged(spark.createDataFrame([], FOUND), k)
    filters = Filters((same,) if isinstance(same, str) else tuple(same or ()), within)
    fits = F.size("embedding") == width
    v, q = _sound(vectors).where(fits).select("vec_id", "embedding", *filters.of_rows()), _sound(queries).where(fits).select("vec_id", "embedding", *filters.of_queries())
    n = q.count()
    if n <= block:
        sent = q.toArrow()  # at most a block

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield from _nearest(pa.Table.from_batches([b]), sent, k, width, filters)

        return _merged(v.mapInArrow(run, FOUND), k)
    of_v, of_q = -(-v.count() // PART), -(-n // block)
    return _merged(_grid(_each(_split(v, of_v, "vp"), of_q, "qp"), _each(_split(q, of_q, "qp"), of_v, "vp"), ["vp", "qp"], k, width, filters), k)


def ladder(vectors: DataFrame, queries: DataFrame, k: int, same: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank, strategy: up to k neighbours above the highest threshold of LADDER that any of them reaches;
    one row without neighbour and with no_match where none does. The rungs' results are nested, so one search serves all."""
    near = knn(vectors, queries, k, same=same).withColumn("_best", F.max("similarity").over(Window.partitionBy("query_id")))
    rung = lambda value: F.coalesce(*(F.when(F.col("_best") >= t, value(t, name)) for t, name in LADDER))
    found = near.where(F.col("similarity") >= rung(lambda t, _: F.lit(t))).withColumn("strategy", rung(lambda _, name: F.lit(name))).drop("_best")
    asked = queries.where("vec_id is not null").select(F.col("vec_id").alias("query_id")).distinct()
    return asked.join(found, "query_id", "left").withColumn("strategy", F.coalesce("strategy", F.lit("no_match")))


# ---- the partitioned index ----------------------------------------------------------------------


def centres(sample: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centres of the cells by spherical k-means over a sample of unit vectors; an empty cell takes the worst placed vector."""
    rng = np.random.default_rng(seed)
    c = sample[np.sort(rng.permutation(len(sample))[:cells])]
    for _ in range(rounds):
        cell, close = np.empty(len(sample), np.int64), np.empty(len(sample))
        for i in range(0, len(sample), SLICE):
            sim = sample[i : i + SLICE] @ c.T
            cell[i : i + SLICE], close[i : i + SLICE] = sim.argmax(axis=1), sim.max(axis=1)
        new = np.zeros_like(c)
        np.add.at(new, cell, sample)
        empty = np.flatnonzero(np.bincount(cell, minlength=len(c)) == 0)
        new[empty] = sample[np.argsort(close, kind="stable")[: len(empty)]]
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return c


def _probed(c: np.ndarray, probes: int, width: int):
    """Rows with each of the nearest cells of their vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            u = _unit(t.column("embedding"), width)
            near = np.concatenate([_best(np.rint(u[i : i + SLICE] @ c.T * 1e9).astype(np.int64), probes) for i in range(0, len(u), SLICE)] or [np.zeros((0, probes), np.int64)])
            rows = t.take(pa.array(np.repeat(np.arange(len(u)), near.shape[1]))).append_column("cell", pa.array(near.ravel().astype(np.int64)))
            yield from rows.to_batches()

    return run


def build_index(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, rounds: int = 10, seed: int = 1) -> None:
    """Writes the vectors by the cell of the nearest centre, with all their columns, and the centres, under `path`. The centres are learned
    from the `sample` vectors with the least hashes of vec_id; every vector is stored. By default there are about as many
    cells as the root of the vectors' number, at most CELLS; a cell is spread over files of at most PART vectors."""
    width = _width(vectors)
    if width is None:
        raise ValueError("no vector to index")
    v = _sound(vectors).where(F.size("embedding") == width)
    n = v.count()
    some = v.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample).select("embedding").toArrow()  # the documented sample
    u = _unit(some.column("embedding"), width)
    c = centres(u, max(1, min(cells or round(n**0.5), CELLS, len(u))), rounds, seed)
    schema = v.withColumn("cell", F.lit(0).cast("long")).schema
    stored = v.mapInArrow(_probed(c, 1, width), schema)
    stored.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // PART // len(c))))).write.mode("overwrite").option("maxRecordsPerFile", PART).partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(i, x.tolist()) for i, x in enumerate(c)]
    v.sparkSession.createDataFrame(rows, "cell long, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, block: int = 4096, same: str | Sequence[str] | None = None, within: str | None = None) -> DataFrame:
    """query_id, vec_id, similarity, rank: the k most similar other rows in the `probes` cells that are nearest to each query, under its
    filters (see Filters). Only the probed cells are read."""
    stored = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()  # at most CELLS
    width = len(stored.column("centre")[0])
    c = _unit(stored.column("centre"), width)
    filters = Filters((same,) if isinstance(same, str) else tuple(same or ()), within)
    q = _sound(queries).where(F.size("embedding") == width).select("vec_id", "embedding", *filters.of_queries())
    q = q.mapInArrow(_probed(c, min(probes, len(c)), width), q.withColumn("cell", F.lit(0).cast("long")).schema)
    per = {r["cell"]: r["n"] for r in q.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CELLS
    v = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(list(per))).select("vec_id", "embedding", F.col("cell").cast("long").alias("cell"), *filters.of_rows())
    if sum(per.values()) <= block:
        sent = q.toArrow()  # at most a block
        cell_of = sent.column("cell").to_numpy()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = b.column("cell").to_numpy()
                for cell in np.unique(own):
                    yield from _nearest(pa.Table.from_batches([b]).filter(pa.array(own == cell)), sent.filter(pa.array(cell_of == cell)), k, width, filters)

        return _merged(v.mapInArrow(run, FOUND), k)
    # a hot cell is split on both sides, so that no group has more than a part of its vectors and a block of its queries
    of_v = v.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).alias("of_v"))
    of_q = q.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("of_q"))
    of = F.broadcast(of_v.join(of_q, "cell"))  # at most CELLS
    put = lambda df, own, name, other, each: df.join(of, "cell").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col(own))).withColumn(each, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("of_v", "of_q")
    return _merged(_grid(put(v, "of_v", "vp", "of_q", "qp"), put(q, "of_q", "qp", "of_v", "vp"), ["cell", "vp", "qp"], k, width, filters), k)
