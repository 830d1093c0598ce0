"""What the sorted orders miss is found all the same."""

import numpy as np
import pytest
from test_nndescent import SCHEMA, plain, vectors

from flowlens.llm import nndescent as N


def results(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in N.near_duplicates(df).collect())


@pytest.mark.parametrize("block", [1024, 8])
def test_saturated_groups_that_never_meet(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "audit", lambda *a: 1.0)
    orders = N.sorted_neighbours
    monkeypatch.setattr(N, "sorted_neighbours", lambda *a, **k: orders(*a, **k).where("s >= 0.99 or s < 0.9"))
    rng = np.random.default_rng(4)
    axes = np.linalg.qr(rng.standard_normal((64, 4)))[0].T
    rows = []
    for centre in (axes[0], axes[0] * 0.983 + axes[1] * (1 - 0.983**2) ** 0.5, axes[2]):
        for _ in range(16):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(0, 0.001, 64)], 1, "x"))
    want = sorted(plain(rows))
    assert len({w[2] for w in want}) == 2 and min(w[1] for w in want) == 15
    assert results(spark, rows) == want


def test_failed_audits_end_in_whole_comparison(spark, monkeypatch):
    orders = N.sorted_neighbours
    monkeypatch.setattr(N, "sorted_neighbours", lambda *a, **k: orders(*a, **k).where("s > 2"))
    monkeypatch.setattr(N, "BLOCK", 64)
    rows = vectors()
    assert results(spark, rows) == sorted(plain(rows))


def grouped(sizes, unlinked, seed=6):
    rng, rows = np.random.default_rng(seed), []
    for size in sizes:
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, [float(x) for x in centre + rng.normal(0, 0.01, 16)], 1, "x") for k in range(size)]
    return rows + [(len(rows) + k, [float(x) for x in rng.standard_normal(16)], 1, "x") for k in range(unlinked)]


def test_audit_sees_lost_pairs_beside_a_hot_group(spark):
    nodes = N.nodes_of(spark.createDataFrame(grouped([200, *[2] * 40], 300), SCHEMA))
    hot = nodes.where("least < 200").selectExpr("node", "199L as links")
    likely = nodes.where("least < 280").select("node")
    assert N.audit(nodes, hot, likely, 0.98, 140) < N.RECALL
    every = hot.union(nodes.where("least between 200 and 279").selectExpr("node", "1L as links"))
    assert N.audit(nodes, every, likely, 0.98, 140) == 1.0
    # found by the sample alone, which grows until enough of its nodes have links
    assert N.audit(nodes, every, likely.limit(0), 0.98, 20) == 1.0


def test_unmeasured_recall_is_no_recall(spark, monkeypatch):
    """Few or no links among many vectors: the audit says so, and the whole comparison finds what there is."""
    rows = grouped([2, 3], 3000)
    nodes = N.nodes_of(spark.createDataFrame(rows, SCHEMA))
    nothing = nodes.limit(0).selectExpr("node", "0L as links")
    assert N.audit(nodes, nothing, nodes.limit(0).select("node"), 0.98, 64) is None
    orders = N.sorted_neighbours
    monkeypatch.setattr(N, "sorted_neighbours", lambda *a, **k: orders(*a, **k).where("s < 0.9"))
    monkeypatch.setattr(N, "neighbours_of_neighbours", lambda *a, **k: orders(a[0], 0).where("s > 2"))
    got = results(spark, rows)
    assert [g for g in got if g[1]] == [(0, 1, 0), (1, 1, 0), (2, 2, 2), (3, 2, 2), (4, 2, 2)]


def test_wide_components_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(N, "audit", lambda *a: 1.0)
    monkeypatch.setattr(N, "WIDE", 0)
    rows = grouped([16, 16, 14], 40)
    assert results(spark, rows) == sorted(plain(rows))


def test_audit_memory_is_bounded(spark):
    """20,000 vectors without links: what a worker needs beside its Arrow batches stays far under 500 MB."""
    import resource

    import pyarrow as pa
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], 1, "x") for i, v in enumerate(rng.standard_normal((20_000, 16)))]
    nodes = N.nodes_of(spark.createDataFrame(rows, SCHEMA).repartition(4))
    nothing = nodes.limit(0).selectExpr("node", "0L as links")
    assert N.audit(nodes, nothing, nothing.select("node"), 0.98) is None

    def peak(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]})

    assert max(r.mb for r in spark.range(8).repartition(8).mapInArrow(peak, "mb double").collect()) < 500
