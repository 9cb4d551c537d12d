"""Line dedup of null, repeated and clashing ids against brute force."""

import hashlib
import random
from collections import Counter

from tessera.llm import line_dedup


def test_null_repeated_and_clashing_ids(spark):
    rng, least = random.Random(9), 8
    lines = [" ".join(f"x{rng.randint(0, 99)}" for _ in range(rng.randint(1, 5))) for _ in range(12)]
    rows = [(rng.choice([None, 3, 3, 4, 5 + i]), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for i in range(24)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (4, rows[2][1]), (4, rows[2][1]), (None, None)]
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    own, seen, want = [[x for x in t.split("\n") if x.strip()] for _, t in order], {}, Counter()
    runs = [(n, a, b, tuple(t[a:b])) for n, t in enumerate(own) for a in range(len(t)) for b in range(a + 1, len(t) + 1)]
    for n, a, _, run in runs:
        seen.setdefault(run, (n, a))
    gone = {(n, j) for n, a, b, run in runs if sum(len(x.split()) for x in run) >= least and seen[run] < (n, a) for j in range(a, b)}
    for n, (i, t) in enumerate(order):
        k, kept = 0, []
        for x in t.split("\n"):
            if not (x.strip() and (n, k) in gone):
                kept.append(x)
            k += bool(x.strip())
        want[i, "\n".join(kept), sum(m == n for m, _ in gone)] += 1
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(table, least).collect()) == want
