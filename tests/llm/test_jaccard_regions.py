"""The Jaccard join where regions are split over many tasks and where ids repeat or are null, against brute force."""

import random

from tessera.llm import jaccard_join


def brute(rows, k, percent):
    """(doc_id, n_shingles, component_id) of each row."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in text or "").split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def found(spark, rows, k, percent):
    df = spark.createDataFrame([(d, t, 0, 0, "x") for d, t in rows], "doc_id long, text string, part int, m long, comp string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, percent).collect()), key=repr)


def chain(rng, n, size):
    """Texts that share a passage, of which some differ in little from the one before."""
    shared = [f"p{i}" for i in range(size)]
    out = []
    for i in range(n):
        own = list(out[-1].split()[size:]) if out and i % 3 else [f"o{rng.randrange(10**6)}" for _ in range(size)]
        own[rng.randrange(size)] = f"n{i}"
        out.append(" ".join(shared + own))
    return out


def test_split_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SPLIT", 3)
    monkeypatch.setattr(jaccard_join, "OFTEN", 1 << 40)  # no shingle comes last, so that the passage makes large regions
    rows = list(enumerate(chain(random.Random(4), 40, 30)))
    got = found(spark, rows, 3, 80)
    assert got == brute(rows, 3, 80)
    assert 1 < len({c for *_, c in got}) < len(rows)


def test_regions_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_REGIONS", 0)
    rows = list(enumerate(chain(random.Random(5), 20, 30)))
    assert found(spark, rows, 3, 80) == brute(rows, 3, 80)


def test_ids_that_repeat_or_are_null(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(2, a), (0, a), (2, b), (1, b), (None, a), (None, "c d e f g"), (None, None), (7, ""), (7, "")]
    assert found(spark, rows, 4, 85) == brute(rows, 4, 85)
