"""Fair queueing against a plain simulation."""

import hashlib
import random
import re

import pytest

from flowlens.llm import mixing as M

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(rows, weights, epochs, share, seed):
    """One (doc_id, size, source_size, target, taken) per row of (doc_id, source, text)."""
    sizes = [len(WORD.findall(t or "")) for _, _, t in rows]
    order = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total_of = {s: sum(n for n, r in zip(sizes, rows, strict=True) if r[1] == s) for s in order}
    budget = share * sum(sizes)
    target, open_, left = {}, set(order), budget
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * total_of[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = epochs * total_of[s]
            left -= target[s]
        open_ -= over
    key = [hashlib.md5("|".join([seed, "" if i is None else str(i), s or "", t or ""]).encode()).hexdigest() for i, s, t in rows]
    copies = []
    for s in order:
        at = 0
        for e in range(epochs):
            for k in sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: key[k]):
                at += sizes[k]
                if sizes[k]:
                    copies.append((at / weight[s], order.index(s), key[k], e, k))
    taken, run = [0] * len(rows), 0
    for *_, k in sorted(copies):
        run += sizes[k]
        if run > budget:
            break
        taken[k] += sizes[k]
    return [(r[0], n, total_of[r[1]], target[r[1]], w) for r, n, w in zip(rows, sizes, taken, strict=True)]


def corpus(seed, sources, n):
    rng = random.Random(seed)
    return [(i, rng.choice(sources), " \n".join(["w"] * rng.choice([0, 1, 3, 20, 90]))) for i in range(n)]


@pytest.mark.parametrize(("seed", "sources", "weights", "epochs", "share"), [
    (1, ["a", "b", None, "é", "z"], (5.0, 2.0, 1.0), 3, 1.0), (2, ["a"], (5.0, 2.0, 1.0), 3, 1.0),
    (3, ["a", "b"], (100.0, 1.0), 3, 1.0), (4, ["a", "b", "c"], (1.0,), 2, 1.7), (5, ["a", "b"], (3.0, 1.0), 1, 1.0)])
def test_equals_simulation(spark, seed, sources, weights, epochs, share):
    rows = [*corpus(seed, sources, 300), (900, sources[0], None)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, text string, size int").repartition(4)
    out = M.allot(df, weights, epochs, share, "s")
    got = sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in out.collect())
    assert got == [(*w[:3], round(w[3], 6), w[4]) for w in plain(rows, weights, epochs, share, "s")]
    mixed = M.mix(df, weights=weights, max_epochs=epochs, share=share, seed="s")
    assert mixed.columns == df.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {g[0]: g[4] // g[1] for g in got if g[4]}


def test_repeats_and_edges(spark):
    rows = [(1, "a", "x y"), (1, "a", "x y"), (1, "a", "x y"), (None, None, "q"), (None, None, None), (2, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = M.allot(df).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r.size for r in got)
    assert M.mix(df).groupBy("doc_id", "source").count().count() <= 3
    assert sum(len(WORD.findall(r.text)) for r in M.mix(df).collect()) == sum(r.taken for r in got)
    assert M.allot(df.limit(0)).count() == 0 and M.mix(df.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, "a", " "), (2, None, None)], "doc_id long, source string, text string")
    assert [(r.size, r.taken) for r in M.allot(blank).collect()] == [(0, 0), (0, 0)] and M.mix(blank).count() == 0


def test_mix_keeps_every_column_of_alike_rows(spark):
    """Rows equal in doc_id, source and text but not in others, a null beside an empty source, and nulls as values."""
    schema = "doc_id long, source string, text string, lang string, n long"
    rows = [(1, None, "a b", "x", 1), (1, "", "a b", "x", 1), (1, None, "a b", None, 1), (1, None, "a b", "", None),
            (2, "s", "c", "n", None), (2, "s", "c", "n", None), (3, "s", "d e f", "v1:x", 2)]
    df = spark.createDataFrame(rows, schema)
    want, got = {}, {}
    for r in M.allot(df).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.epochs
    for r in M.mix(df).collect():
        assert tuple(r) in rows
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    sources = {s: sum(n for k, n in want.items() if k[1] == s) for s in (None, "", "s")}
    assert sources[""] > 0 and sources[None] > 0
