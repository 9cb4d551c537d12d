"""Fuzzy ratios against a plain dynamic program; file sources; streaming stages; nulls of the vector search."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy
from tessera.functions import text as T
from tessera.operators.vectors import knn
from tessera.sources import files
from tessera.streaming import stages


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratios():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab c") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert fuzzy.common(a, b) == lcs(a, b)
    assert fuzzy.ratio("L200", "L 200") == 8 / 9 and fuzzy.set_ratio("ford fiesta", "fiesta ford x") == 1.0 and fuzzy.set_ratio("", "x") == 0.0
    assert fuzzy.set_ratio("a b c", "a b d") == max(lcs("a b c", "a b d") * 2 / 10, 2 * 3 / 8)


def test_ratio_columns(spark):
    rows = spark.createDataFrame([("L200", "L 200"), ("Hilux", "hilux"), ("Hilux", "Hilux SR"), (None, "x")], "a string, b string")
    assert [r[0] for r in rows.select(fuzzy.model_ratio(F.col("a"), F.col("b"))).collect()] == [8 / 9, 1.0, 0.9, None]


def test_sheets(spark, tmp_path):
    (tmp_path / "utf.csv").write_text("Marca,Modelo,Año,Desc,Clave\nPeña,x,2001,d,c1\n,x,2001,d,c2\n", encoding="utf-8")
    (tmp_path / "latin.csv").write_text("Marca,Modelo,Año,Desc,Clave\nPeña,x,0,d,c1\n", encoding="latin-1")
    for name in ("utf", "latin"):
        own = files.catalogue(files.read_sheet(spark, f"file://{tmp_path}/{name}.csv"))
        assert [(r.brand, r.code) for r in own.collect()] == [("Peña", "c1")]
    with pytest.raises(ValueError):
        files.read_sheet(spark, "x.xlsx")
    with pytest.raises(ValueError):
        files.catalogue(spark.createDataFrame([("a",)], "marca string"))
    assert files.null_shares(spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "a string, b int")) == {"a": 2 / 3}


def test_rows_and_derived(spark, tmp_path):
    path = f"file://{tmp_path}/rows"
    for run in ("r1", "r2"):
        files.append_rows(spark.createDataFrame([(1, run)], "i int, x string"), path, run)
    assert [r.x for r in files.rows_of(spark, path, "r2").collect()] == ["r2"]
    built = []
    build = lambda p: built.append(p) or spark.read.parquet(p)
    for _ in range(2):
        assert files.derived(spark, path, f"file://{tmp_path}/copy", build).count() == 2
    assert len(built) == 1
    v = spark.createDataFrame([(1, None), (2, [0.5])], "k int, embedding array<double>")
    made = files.without_vector(v).select("k", F.array(F.lit(1.0)).alias("embedding"))
    assert {r.k: r.embedding for r in files.filled(v, made, "k").collect()} == {1: [1.0], 2: [0.5]}


def test_stage_runs_once_for_each_message(spark, tmp_path):
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    work = lambda m: m.withColumn("y", F.col("x") * 2)
    for rows in ([(1,), (2,)], [(3,)]):
        spark.createDataFrame(rows, "x int").write.mode("append").parquet(source)
        got = stages.run(spark, source, spark.read.parquet(source).schema, out, f"file://{tmp_path}/c", work)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (2, 4), (3, 6)]


def test_knn_without_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (None, [1.0, 0.0]), (20, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.vec_id) for r in knn(v, v.where("vec_id % 20 = 0"), 5).collect()} == {(0, 20), (20, 0)}


def test_sheets_of_two_encodings(spark, tmp_path):
    (tmp_path / "s.csv").mkdir()
    (tmp_path / "s.csv" / "a.csv").write_bytes("marca,año\nCitroën,2019\nx,\n".encode())
    (tmp_path / "s.csv" / "b.csv").write_bytes("marca,año\nCitroën,2020\n".encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8b", "128m"):  # also where files are split
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.read_sheet(spark, f"file://{tmp_path}/s.csv")
            assert sorted(tuple(r) for r in got.collect()) == [("Citroën", "2019"), ("Citroën", "2020"), ("x", None)]
            assert {c.lower() for c in got.columns} <= {"marca", "año"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_letters_without_their_accents(spark):
    df = spark.createDataFrame([("Łódź ñÑ ệ ǖ Ž óß",)], "t string")
    assert df.select(T.deburr(F.col("t"))).head()[0] == "Łodz nN e u Z oß"
