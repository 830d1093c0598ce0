"""Byte network: held-out accuracy on separable languages, window coverage, edge cases."""

import random

import numpy as np
import pyarrow as pa
import pytest

from flowlens.llm import langid as L
from flowlens.llm import textbytes as tb

PARTS = {"aa": ["ka", "mu", "lo", "ri"], "bb": ["sch", "ung", "ein", "ß"], "cc": ["que", "é", "aux", "ou"]}


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        words = ["".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(rng.choice([3, 30, 300]))]
        rows.append((i, " ".join(words), lang, "x"))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame(corpus(400), "doc_id long, text string, lang string, score string")
    return df, L.fit(df)


def test_held_out_accuracy(trained):
    df, net = trained
    got = L.predict(df.withColumn("out", L.held_out(df.doc_id)), net).where("out").collect()
    assert 90 < len(got) < 180 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and net.labels == ["aa", "bb", "cc"]


def test_inputs_are_text_only_and_edges(spark, trained):
    _, net = trained
    long = "ein ung sch " * 100_000
    rows = [(1, None, "aa"), (2, "", None), (None, "1 2 $", "bb"), (3, long, None), (4, "é", "zz"), (4, "é", "aa")]
    got = {(r.doc_id, r.lang): (r.lang_pred, r.score) for r in
           L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()}
    assert [got[k][0] for k in ((1, "aa"), (2, None), (None, "bb"))] == ["und"] * 3 and got[1, "aa"][1] == 0
    assert got[3, None][0] == "bb" and got[4, "zz"] == got[4, "aa"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.fit(empty) is None and L.predict(empty, None).count() == 0
    unlabelled = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.fit(unlabelled) is None and L.predict(unlabelled, None).first().lang_pred == "und"


def test_windows_cover_whole_text_one_by_one(trained):
    _, net = trained
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdé ", k=n)) for n in (1, 253, 254, 256, 257, 700, 0, 40_000)]
    whole = []
    for t in texts:  # plain: each text alone, position by position
        data = t.encode()
        if not data:
            whole.append(np.zeros(3))
            continue
        n = -(-len(data) // L.WINDOW)
        index = np.full(n * L.WINDOW + 3, L.PAD)
        index[:len(data)] = list(data)
        p = 0
        for w in range(n):
            window = index[w * L.WINDOW:(w + 1) * L.WINDOW + 3]
            p = p + net.probabilities(window[None])[0] * max(0, min(L.WINDOW, len(data) - w * L.WINDOW))
        whole.append(p / len(data))
    for limit in (1, 1 << 20):
        got = np.concatenate([L.identify(t, net) for _, _, t in tb.chunks(pa.array(texts), limit)])
        assert np.allclose(got, whole, atol=1e-5)


def test_gradients_fit_training_data():
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 2, 200)
    windows = np.where(rng.random((200, L.WINDOW + 3)) < 0.5, 97 + truth[:, None], 120).astype(np.int16)
    net = L.train(windows, truth, ["a", "b"])
    assert (np.array([net.probabilities(w[None])[0].argmax() for w in windows]) == truth).mean() == 1


def test_extra_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "abc", "kept", "too")], ["doc_id", "text", "has letter", "Has Letter'"])
    got = L.predict(df, None)
    assert got.columns == [*df.columns, "lang_pred", "score"] and tuple(got.first())[:4] == (1, "abc", "kept", "too")
