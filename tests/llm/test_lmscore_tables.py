"""Counts stay apart where the words are more than any fixed table holds."""

import math
import random
from collections import Counter

import pytest

from flowlens.llm import lmscore as S


def plain(rows, chosen):
    """Scores by unhashed counts, for texts in lower case; the totals are taken once."""
    models = []
    for texts in ([t for i, t in rows if i in chosen], [t for _, t in rows]):
        single, first, pair = Counter(), Counter(), Counter()
        for t in texts:
            ws = t.split()
            single.update(ws)
            first.update(["<s>", *ws[:-1]])
            pair.update(zip(["<s>", *ws], ws, strict=False))
        models.append((single, first, pair, single.total()))
    size = max(1 << S.WORD_BITS, len(models[1][0]))

    def loss(m, ws):
        out = 0.0
        for c, w in zip(["<s>", *ws], ws, strict=False):
            p = (m[0][w] + S.PRIOR) / (m[3] + S.PRIOR * size)
            out -= math.log(S.MIX * m[2][c, w] / m[1][c] + (1 - S.MIX) * p if m[1][c] else p)
        return out / len(ws)

    return [(i, len(t.split()), *[loss(m, t.split()) for m in models]) for i, t in rows]


@pytest.mark.parametrize("block", [1 << 23, 20_000])
def test_more_words_than_slots(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "MIN_BLOCKS", 3)
    rng = random.Random(2)
    names = [f"w{i:x}" for i in range(250_000)]
    rng.shuffle(names)
    rows = [(i, " ".join(names[i * 5000:(i + 1) * 5000])) for i in range(50)]
    rows += [(100 + i, " ".join(rng.choices(names, k=400))) for i in range(40)]
    rows += [(200 + i, f"of the {names[i]} of the") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    chosen = set(range(0, 300, 3))
    ids = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    got = {r.doc_id: (r.n_tokens, r.loss_target, r.loss_background) for r in S.cross_entropy_difference(df, ids).collect()}
    want = plain(rows, chosen)
    assert len(got) == len(want)
    for i, *w in want:
        assert got[i] == pytest.approx(tuple(w), rel=1e-9)


def test_prior_is_spread_over_all_words(spark):
    n = (1 << 18) + 5000
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, n, 20))) for i in range(20)], "doc_id long, text string")
    out = S.cross_entropy_difference(df, spark.createDataFrame([], "doc_id long")).collect()
    # no target: each of the n words is as likely as any other
    assert all(r.loss_target == pytest.approx(math.log(n), rel=1e-9) for r in out) and len(out) == 20
