"""Ties of knn beyond any fixed number of spare places."""

import numpy as np

from tessera.operators.vectors import knn


def test_many_copies_are_settled_by_id(spark):
    rng = np.random.default_rng(1)
    one, ids = rng.normal(size=8).tolist(), rng.permutation(600)
    rows = [(int(i), one if i % 3 == 0 else rng.normal(size=8).tolist()) for i in ids]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = knn(v, v.where("vec_id % 20 = 0"), 25, block=16).collect()
    m = np.array([e for _, e in sorted(rows)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    sim = np.round(m @ m.T, 6)
    want = {q: [i for i in np.lexsort((np.arange(600), -sim[q])) if i != q][:25] for q in range(0, 600, 20)}
    assert {(r.query_id, r.rank): (r.vec_id, r.similarity) for r in got} == {(q, n + 1): (i, sim[q, i]) for q, own in want.items() for n, i in enumerate(own)}


def test_memory_of_a_comparison_is_bounded():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from tessera.operators.vectors import PART, Filters, _nearest

    r = np.random.default_rng(1)
    rows = lambda n: pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(r.normal(size=n * 8).astype(np.float32)), 8).cast(pa.list_(pa.float32()))})
    v, q = rows(PART), rows(600)
    tracemalloc.start()
    got = pa.Table.from_batches(list(_nearest(v, q, 5, 8, Filters())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 600 * 5 and peak < 60e6
