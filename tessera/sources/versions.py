"""Tables that are updated by key: only the buckets that hold changed keys are written anew, and readers switch at once.

A table is a folder of bucket folders by version and a manifest for each version, which names the version of every bucket. A
manifest is written under another name and renamed when all its data is there, so a reader sees a whole version or the one
before, and a write that fails changes nothing. Of two writers that start from one version the second fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def version(spark: SparkSession, path: str) -> int:
    """The latest version; 0 where there is none."""
    p, fs = _fs(spark, f"{path}/manifests")
    return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=0) if fs.exists(p) else 0


def _manifest(spark: SparkSession, path: str, number: int) -> dict[int, str]:
    return {r["bucket"]: r["folder"] for r in spark.read.parquet(f"{path}/manifests/{number}").collect()} if number else {}  # a row for each bucket


def _commit(spark: SparkSession, path: str, number: int, folders: dict[int, str]) -> None:
    draft = f"{path}/manifests/_draft-{uuid.uuid4().hex}"
    spark.createDataFrame(sorted(folders.items()), "bucket int, folder string").coalesce(1).write.parquet(draft)
    (a, fs), (b, _) = _fs(spark, draft), _fs(spark, f"{path}/manifests/{number}")
    if fs.exists(b) or not fs.rename(a, b):
        raise RuntimeError(f"version {number} of {path} was written by another")


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, key: list[str], buckets: int) -> str:
    folder = f"data/{uuid.uuid4().hex}"
    df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    return folder


def create(df: DataFrame, path: str, key: list[str], buckets: int = 64) -> None:
    """Writes df as the first version. The number of buckets stays; choose it so that a bucket fits a task."""
    spark = df.sparkSession
    if version(spark, path):
        raise RuntimeError(f"{path} is there already")
    folder = _write(df, path, key, buckets)
    _commit(spark, path, 1, {b: folder for b in range(buckets)})


def read(spark: SparkSession, path: str, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a version, the latest by default; of some buckets only where these are given."""
    folders = _manifest(spark, path, number or version(spark, path))
    out = None
    for folder in sorted(set(folders.values())):
        own = [b for b, f in folders.items() if f == folder and (buckets is None or b in buckets)]
        some = spark.read.parquet(f"{path}/{folder}").where(F.col("bucket").isin(own)).drop("bucket")  # a partition filter
        out = some if out is None else out.unionByName(some)
    if out is None:
        raise RuntimeError(f"no table at {path}")
    return out


def update(spark: SparkSession, path: str, changes: DataFrame, key: list[str], latest: Column | None = None, insert: bool = False) -> int:
    """Writes the columns of changes over the rows of equal key and returns the new version. Of changes to one key the one with the greatest
    `latest` counts, by default any; keys that aren't there are added with insert, else ignored; a null in a key matches none."""
    at = version(spark, path)
    folders = _manifest(spark, path, at)
    whole = F.lit(True)
    for c in key:
        whole &= F.col(c).isNotNull()
    new = [c for c in changes.columns if c not in key]
    order = F.lit(0) if latest is None else latest
    one = changes.where(whole).groupBy(*key).agg(F.max_by(F.struct(*new), order).alias("_new"))
    hit = [r[0] for r in one.select(_bucket(key, len(folders)).alias("b")).distinct().collect()]  # a row for each bucket
    if not hit:
        return at
    rows = read(spark, path, at, hit)
    put = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) if c in new else F.col(c)
    merged = rows.join(one, key, "full" if insert else "left").select(*(put(c).alias(c) for c in rows.columns))
    folder = _write(merged, path, key, len(folders))
    _commit(spark, path, at + 1, folders | {b: folder for b in hit})
    return at + 1


def overlay(rows: DataFrame, corrections: DataFrame, key: list[str], column: str, value: str, latest: Column) -> DataFrame:
    """The rows with `column` replaced by the value of the latest correction of their key, where there is one with a value."""
    last = corrections.groupBy(*key).agg(F.max_by(value, latest).alias("_to"))
    return rows.join(last, key, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")
