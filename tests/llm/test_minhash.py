"""Near copies against all pairs of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import minhash as M
from flowlens.llm import textbytes as tb
from flowlens.llm.components import components


def shingles(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0D]+", lower) if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def plain(rows, size, percent):
    """doc_id -> component over all pairs; rows of one doc_id are one document."""
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in root}


def family(rng):
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(14):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 5, 30, 80, 200]))
        for _ in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "\n", "\t "]).join(text).upper() if rng.random() < 0.3 else " ".join(text)))
            n += 1
    rng.shuffle(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[0][1]), rows[0], (n + 3, "É Ü"), (n + 4, "é ü")]


@pytest.mark.parametrize(("size", "percent", "seed", "leaders"), [(3, 85, 1, 8), (5, 80, 2, 1)])
def test_equals_all_pairs(spark, monkeypatch, size, percent, seed, leaders):
    monkeypatch.setattr(M, "FIRST_LEADERS", leaders)
    rows = family(random.Random(seed))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    want = plain(rows, size, percent)
    got = M.near_duplicates(df, size, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, size)) for _, t in rows)
    kept = M.dedup(df, size, percent)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, c in want.items() if i == c) and ids.count(None) == 1
    assert M.near_duplicates(df.limit(0), size, percent).count() == 0


@pytest.mark.parametrize(("wide", "block"), [(64, 512), (2, 8), (2, 512)])
def test_bucket_of_many_families(spark, monkeypatch, wide, block):
    """One bucket whose members do not all link: links behind the first leader are found as well."""
    monkeypatch.setattr(M, "WIDE", wide)
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "VOCABULARY", 50)
    monkeypatch.setattr(M, "bands", lambda s, rows: np.zeros((len(s), 1), dtype=np.uint64))
    monkeypatch.setattr(M, "FIRST_LEADERS", 1)
    rng = random.Random(3)
    rows = []
    for f in range(9):
        base = [f"f{f}w{i}" for i in range(60)]
        for _ in range(f % 4 + 1):
            rows.append((len(rows), " ".join([*base[:59], f"x{rng.random()}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in M.near_duplicates(df, 3, 85).collect()} == want


def test_ids_that_repeat_join_their_texts(spark):
    """3 and 7 share text A, 7 and 9 share text B: all three reach one another, and so do what links to them."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(80)) for k in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b), (11, b + " tail"), (20, c), (21, c), (20, None), (20, "")]
    got = {(r.doc_id, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {(3, 3), (7, 3), (9, 3), (11, 3), (20, 20), (21, 20)}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 1 << 63, 300).astype(np.uint64)])
    docs = np.repeat([0, 1, 2, 3], [1000, 1000, 1, 2])
    s = M.sketch(docs, np.concatenate([a, b, a[:1], a[:2]]), 5, 512)
    assert (s[:4] != np.uint64(2**64 - 1)).all() and (s[4] == np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 700 / 1300) < 0.07
    assert len(set(s[2].tolist())) == 512 and abs((s[2] == s[3]).mean() - 0.5) < 0.07


def test_shingles_of_chunks():
    texts = pa.array(["A b C", None, "", "a b c d", "x", "x y"])
    for limit in (1, 1 << 20):
        got = {}
        for lo, _, t in tb.chunks(texts, limit):
            doc, h, d1, _ = M.shingle_hashes(t, 3)
            for i, v in zip((doc + lo).tolist(), h.tolist(), strict=True):
                got.setdefault(i, []).append(v)
        assert got[0] == got[3][:1] and len(got[3]) == 2 and len(got[4]) == len(got[5]) == 1 and 1 not in got


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0
