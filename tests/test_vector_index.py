"""The vector index against exact search, searches by grid, ragged vectors and filters against all pairs."""

import numpy as np
import pytest

from tessera.operators import vectors as X


def rows_of(n=900, width=12, seed=1):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(20, width)) * 2
    v = mids[rng.integers(0, 20, n)] + rng.normal(size=(n, width))
    return [(int(i), v[i].tolist(), f"b{i % 3}" if i % 11 else None, 1990 + i % 25) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, brand string, year int"


def brute(rows, asked, k, demand=lambda q, r: True):
    unit = lambda e: np.array(e) / max(np.linalg.norm(e), 1e-300)
    out = set()
    for q in asked:
        near = sorted((-round(float(unit(q[1]) @ unit(r[1])), 6), r[0]) for r in rows if r[0] != q[0] and demand(q, r))[:k]
        out |= {(q[0], i + 1, n, -s) for i, (s, n) in enumerate(near)}
    return out


def found(df):
    return {(r.query_id, r["rank"], r.vec_id, round(r.similarity, 6)) for r in df.collect()}


@pytest.mark.parametrize("block", [4096, 16])
def test_index_recall_and_reads_probed_cells_alone(spark, tmp_path, block):
    rows = rows_of()
    v = spark.createDataFrame(rows, SCHEMA)
    X.build_index(v, f"file://{tmp_path}/i", cells=25)
    asked = v.where("vec_id % 20 = 0")
    exact = {(q, n) for q, _, n, _ in found(X.knn(v, asked, 10))}
    df = X.search_index(spark, f"file://{tmp_path}/i", asked, 10, probes=6, block=block)
    got = {(q, n) for q, _, n, _ in found(df)}
    assert len(got & exact) >= 0.9 * len(exact)
    every = X.search_index(spark, f"file://{tmp_path}/i", asked, 10, probes=25, block=block)
    assert found(every) == found(X.knn(v, asked, 10))  # all cells probed: exact
    one = X.search_index(spark, f"file://{tmp_path}/i", v.where("vec_id = 0"), 10, probes=1)
    assert "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString() or "PartitionFilters: [cell" in one._jdf.queryExecution().toString()


def test_cells_have_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PART", 64)
    same = [(i, [1.0, float(i < 3)]) for i in range(500)]  # nearly all vectors in one cell
    v = spark.createDataFrame(same, "vec_id long, embedding array<double>")
    X.build_index(v, f"file://{tmp_path}/i", cells=2)
    files = list((tmp_path / "i" / "vectors").rglob("*.parquet"))
    assert len(files) >= 8 and spark.read.parquet(f"file://{tmp_path}/i/vectors").count() == 500
    asked = v.where("vec_id % 20 = 0")
    assert found(X.search_index(spark, f"file://{tmp_path}/i", asked, 5, probes=2, block=7)) == found(X.knn(v, asked, 5))


def test_index_of_a_table_and_labels(spark):
    from tessera.plans.contract import queries

    sf = "/root/testdata/sf0.01"
    got = {(r.query_id, r.vec_id) for r in queries()["ann_topk"](spark, sf).collect()}
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = {(r.query_id, r.vec_id) for r in X.knn(v, v.where("vec_id % 20 = 0"), 10).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_grid_and_filters_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(X, "PART", 200)
    rows = rows_of(500)
    asked = [(i, rows[i][1], rows[i][2] if i % 3 else None, 1995 if i % 4 else None, 2008 if i % 5 else None) for i in range(0, 500, 7)]
    q = spark.createDataFrame(asked, "vec_id long, embedding array<double>, brand string, year_min int, year_max int")

    def demand(a, r):
        return (a[2] is None or a[2] == r[2]) and (a[3] is None or r[3] >= a[3]) and (a[4] is None or r[3] <= a[4])

    v = spark.createDataFrame(rows, SCHEMA)
    for block in (4096, 20):
        assert found(X.knn(v, q, 8, block=block, same="brand", within="year")) == brute(rows, asked, 8, demand)


def test_ragged_and_broken_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0, 5.0]), (2, [None, 1.0]), (3, [0.5, 0.5]), (4, []), (5, None), (None, [1.0, 0.0]), (6, [float("nan"), 1.0]), (7, [0.0, 0.0]), (8, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4096, 1):
        assert found(X.knn(v, v.where("vec_id is not null"), 2, block=block)) == brute([r for r in rows if r[0] in (0, 3, 7, 8)], [r for r in rows if r[0] in (0, 3, 7, 8)], 2)
    assert X.knn(v, v.where("vec_id = 5"), 2).count() == 0
    with pytest.raises(ValueError):
        X.build_index(v.where("vec_id = 5"), "unused")
