"""Row ordinals without a global window: counts by part, prefix sums, ordinal = the part's offset + the place in it.

Rows lie in Parquet files in their order first; the place of a row in its file is the reader's own row index. What goes through
the driver is one count for each part or split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.files import work_dir


def _kept(df: DataFrame) -> DataFrame:
    """df written as Parquet in its partitions' order, with _part and _place of each row."""
    path = work_dir(df.sparkSession)
    df.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    rows = df.sparkSession.read.schema(df.withColumn("_part", F.lit(0)).schema).parquet(path)
    return rows.select("*", F.col("_metadata.row_index").alias("_place"))


def _offsets(counts: DataFrame, keys: list[str], n: str, order: list[str]) -> DataFrame:
    """The number of rows before each part; a part is one row here, so the window meets few."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("_offset"))


def numbered(df: DataFrame, order: list[Column], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """df with a long column `name`: 0, 1, 2, ... in that order, over ranges of it that are sorted for themselves. Rows that
    the order leaves equal are numbered in any order."""
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _kept(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    out = rows.join(F.broadcast(_offsets(counts, ["_part"], "_n", ["_part"])), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def file_ordinals(df: DataFrame, name: str = "row_index", per_file: bool = True) -> DataFrame:
    """Rows that were read from files with the number of each in its file (or, without per_file, over all files by path), however
    the files were split. df comes from a file source and still has its _metadata column."""
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    rows = _kept(at)
    key = ["_part", "_file", "_split"]  # a task writes the rows of a split one after another
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    w = Window.partitionBy("_file") if per_file else Window.partitionBy()
    before = F.coalesce(F.sum("_n").over(w.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(F.broadcast(counts.select(*key, "_first", before.alias("_offset"))), key)
    return out.withColumn(name, F.col("_offset") + F.col("_place") - F.col("_first")).drop(*key, "_place", "_first", "_offset")
