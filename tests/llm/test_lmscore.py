"""Cross-entropy difference against plain counts of words and pairs."""

import math
import random
import re
from collections import Counter

import pytest

from flowlens.llm import lmscore as S


def words(text):
    return [w for w in re.split("[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def plain(rows, chosen):
    """Scores by unhashed counts; equal to hashed ones as long as no slots collide."""
    size = 1 << S.WORD_BITS

    def model(texts):
        single, first, pair = Counter(), Counter(), Counter()
        for t in texts:
            ws = words(t)
            single.update(ws)
            first.update(["<s>", *ws][:len(ws)])
            pair.update(zip(["<s>", *ws], ws, strict=False))
        return single, first, pair

    def loss(m, text):
        ws, total = words(text), 0.0
        for c, w in zip(["<s>", *ws], ws, strict=False):
            p = (m[0][w] + S.PRIOR) / (sum(m[0].values()) + S.PRIOR * size)
            if m[1][c]:
                p = S.MIX * min(1, m[2][c, w] / m[1][c]) + (1 - S.MIX) * p
            total -= math.log(p)
        return total / len(ws) if ws else None

    target, back = model([t for i, t in rows if i in chosen]), model([t for _, t in rows])
    return [(i, len(words(t)), loss(target, t), loss(back, t)) for i, t in rows]


def corpus():
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=rng.choice([1, 5, 40])))) for i in range(120)]
    return [*rows, (500, None), (501, " \n"), (502, "G1 g1 g2 " * 20_000), (3, "g1 É é"), (None, "b1 b2")]


def test_equals_plain_counts(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(5)
    ids = spark.createDataFrame([(1,), (3,), (3,), (5,), (7,), (9,), (None,), (999,)], "doc_id long")
    got = S.cross_entropy_difference(df, ids).collect()
    want = plain(rows, {1, 3, 5, 7, 9})
    key = lambda r: (str(r[0]), r[1], str(r[2])[:7])
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.loss_target, r.loss_background) for r in got), key=key),
                    sorted(want, key=key), strict=True):
        assert g[:2] == w[:2]
        if w[2] is None:
            assert g[2] is None and g[3] is None
        else:
            assert g[2:] == pytest.approx(w[2:], rel=1e-5)
    by_id = {r.doc_id: r.score for r in got if r.n_tokens == 40 and r.doc_id is not None}
    mean = [sum(v) / len(v) for v in ([s for i, s in by_id.items() if i % 2 == k] for k in (0, 1))]
    assert mean[1] < mean[0] - 1


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert S.cross_entropy_difference(df, none).first().score > 0
    assert S.cross_entropy_difference(df.limit(0), none).count() == 0
