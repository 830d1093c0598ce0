"""NN-descent links against all pairs."""

import numpy as np
import pytest

from flowlens.llm import nndescent as N

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def plain(rows, threshold=0.98):
    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [i for i in range(n) if usable(rows[i])]
    vec = {i: np.array(rows[i][1], dtype=np.float32).astype(float) for i in good}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(vec[a]) == len(vec[b]):
                x, y = vec[a], vec[b]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold or (x == y).all():
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    groups = {}
    for i in range(n):
        if rows[i][0] is not None:
            groups[find(i)] = min(groups.get(find(i), 1 << 60), rows[i][0])
    return [(r[0], links[i], groups.get(find(i))) for i, r in enumerate(rows)]


def vectors(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    rows = []

    def add(v, label):
        rows.append((len(rows), [float(x) for x in v], label, "x"))

    for _ in range(500):
        add(rng.standard_normal(dim), int(rng.integers(3)))
    for size in (2, 2, 2, 3, 5, 60):
        centre, label = rng.standard_normal(dim), int(rng.integers(3))
        for _ in range(size):
            add(centre * rng.uniform(0.5, 2) + rng.normal(0, 0.04, dim), label)
    for _ in range(30):
        add(rows[7][1], rows[7][2])
    add(rows[7][1], (rows[7][2] + 1) % 3)
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = vectors()
    order = np.random.default_rng(5).permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], SCHEMA).repartition(4)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in N.near_duplicates(df).collect())
    want = plain(rows)
    found = sum(min(g[1], w[1]) for g, w in zip(got, want, strict=True))
    assert found >= 0.97 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert np.mean([g[2] == w[2] for g, w in zip(got, want, strict=True)]) > 0.99
    assert all(g[3] == (g[0] == g[2]) for g in got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, "a"), (2, [2.0, 0.0], 1, "a"), (3, [1.0, 0.0], None, "a"), (4, None, 1, "a"), (5, [0.0, 0.0], 1, "a"),
            (6, [nan, 1.0], 1, "a"), (7, [inf, 1.0], 1, "a"), (8, [1.0, None], 1, "a"), (9, [], 1, "a"), (10, [1.0, 0.0, 0.0], 1, "a"),
            (11, [1.0, 0.0, 0.0], 2, "a"), (12, [0.0, 1.0], 1, "a"), (12, [0.0, 1.0], 1, "a"), (None, [0.0, 1.0], 1, "a"),
            (None, [1.0, 1.0], 2, "a"), (13, [-0.0, 1.0], 1, "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted(plain(rows), key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert N.near_duplicates(df.where("embedding is null")).collect()[0].kept
