"""File sources and sinks: sheets by suffix and encoding, catalogues by header synonyms, derived copies, row tables by run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.profile import extract

REQUIRED = ("brand", "model", "year", "description", "code")
SYNONYMS = {"brand": ("brand", "marca"), "model": ("model", "modelo", "submarca"), "year": ("year", "año", "anio", "modelo_año"), "description": ("description", "descripcion", "desc"), "code": ("code", "clave", "cvegs", "cvegs_code")}


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, else in the warehouse; a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        base = "file://" + tempfile.mkdtemp(prefix="tessera-") if master.startswith("local") and "cluster" not in master else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a new folder of work_dir, for what several branches of a plan read."""
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_sheet(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV sheets with a header, all columns text. Each file is read as UTF-8 if all its rows are, else as Latin-1; files are split over
    tasks, unless values may hold line ends (multi_line). Other suffixes raise ValueError: a spreadsheet reader isn't part of
    this library."""
    if not path.lower().rstrip("/").endswith(".csv"):
        raise ValueError(f"no reader for {path}")
    raw = spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=multi_line)  # a letter for each byte
    columns = raw.columns
    rows = raw.select("*", F.col("_metadata.file_path").alias("_file"))
    back = lambda c: F.encode(F.col(f"`{c}`"), "ISO-8859-1")
    valid = F.lit(True)
    for c in columns:
        valid &= F.coalesce(F.is_valid_utf8(back(c).cast("string")), F.lit(True))
    latin = rows.where(~valid).select("_file").distinct().withColumn("_latin", F.lit(True))  # at most a row for each file
    out = rows.join(F.broadcast(latin), "_file", "left")

    def name(c: str) -> str:
        try:
            return c.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return c

    return out.select(*(F.when(F.col("_latin"), F.col(f"`{c}`")).otherwise(back(c).cast("string")).alias(name(c)) for c in columns))


def dataset_path(insurer: str, registry: dict[str, str], default: str, root: str = "data") -> str:
    """Where an insurer's catalogue lies: its entry of the registry, the default one, or a name made of it."""
    return registry.get(insurer) or (default if insurer == "default" else f"{root}/{insurer}.csv")


def catalogue(sheet: DataFrame, synonyms: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Canonical catalogue of a sheet: columns by synonyms, cleaned, rows without brand, model or code dropped. Raises ValueError where
    no header of a required column is there."""
    own = synonyms or SYNONYMS
    there = {c.strip().lower() for c in sheet.columns}
    missing = [c for c in REQUIRED if not there & set(own[c])]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    out = extract(sheet, {c: own[c] for c in REQUIRED}).withColumn("year", T.first_year(F.col("year")))
    return out.dropna(subset=["brand", "model", "code"])


def null_shares(df: DataFrame, most: float = 0.5) -> dict[str, float]:
    """Columns with more than that share of nulls, in one pass."""
    if not df.columns:
        return {}
    r = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns)).head()
    return {c: r[c] for c in df.columns if r[c] is not None and r[c] > most}


def derived(spark: SparkSession, source: str, copy: str, build) -> DataFrame:
    """The derived copy of a source, built again where it is missing or older than the source's newest file."""
    newest = lambda p: spark.read.format("binaryFile").load(p).agg(F.max("modificationTime")).head()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(copy)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) or newest(copy) < newest(source):
        build(source).write.mode("overwrite").parquet(copy)
    return spark.read.parquet(copy)


def append_rows(df: DataFrame, path: str, run_id: str) -> None:
    """Adds the rows of a run to a table that is partitioned by run, so a run's scan reads its own folder alone."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def rows_of(spark: SparkSession, path: str, *runs: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run_id").isin(*runs))


def without_vector(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The incremental scan: rows whose vector isn't made yet."""
    return df.where(F.col(vector).isNull())


def filled(df: DataFrame, made: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """The table with vectors written where there were none."""
    new = made.select(key, F.col(vector).alias("_made"))
    return df.join(new, key, "left").withColumn(vector, F.coalesce(vector, "_made")).drop("_made")


def labelled(df: DataFrame) -> DataFrame:
    """Labelled rows for evaluation; a year of 0 or one that is no number is null."""
    return df.withColumn("year", F.nullif(F.col("year").try_cast("int"), F.lit(0)))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
